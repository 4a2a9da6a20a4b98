"""Camera streams: late and repeated frames, cutting into sequences, a tracker, all with typed state for each camera.

Frames arrive as rows (camera, frame_id, ts, detections: array of cx, cy, w, h, confidence), empty ones too. Rows of a batch are taken in the order of time, then frame id. Frames that come too late aren't lost in a counter: they leave by the same output with their verdict, so they can be routed and counted.
A camera that sends nothing for `idle` of event time loses its state by an event timer; rows older than that behind the newest of all cameras are dropped by the watermark before they reach it. State is kept in RocksDB, which the operators set for the session.
Cameras are dealt by hash over `groups`, and the state of a group is one value: a batch pays the way to the state and back by group, not by camera. A task holds the state and a batch's frames of one group at a time; with many more cameras than a hundred a group, give more groups. Another number of groups needs a new checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from ..operators.tracking import Linker

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONFIRMATIONS = "camera long, kind string, track_id int, frame_id string, ts timestamp, frame_idx int"
VERDICTS = "camera long, frame_id string, ts timestamp, verdict string"
SESSIONS = "camera long, frame_id string, ts timestamp, session_id int"
#: Groups that cameras are dealt over by hash; their number belongs to the checkpoint.
GROUPS = 1024


def deduplicated(frames: DataFrame, lateness: str) -> DataFrame:
    """Frames in time, each id once; later ones than the watermark allows are dropped and counted in the query's progress (numRowsDroppedByWatermark)."""
    return frames.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["camera", "frame_id"])


def sessions(frames: DataFrame, gap: str, lateness: str | None = None) -> DataFrame:
    """Sequences of a camera: frames less than `gap` apart. camera, started, ended (of the last frame, plus gap), n_frames. For streams give the lateness."""
    rows = frames.withWatermark("ts", lateness) if lateness else frames
    cut = rows.groupBy("camera", F.session_window("ts", gap)).agg(F.count("*").alias("n_frames"))
    return cut.select("camera", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n_frames")


def sessions_batch(frames: DataFrame, gap_seconds: float) -> DataFrame:
    """Batch twin of `sessions` that keeps the frames: session_id from 0 in each camera. A frame exactly gap_seconds after the last begins a new one."""
    by = Window.partitionBy("camera").orderBy("ts", "frame_id")
    seconds = F.unix_micros("ts") / 1e6
    apart = F.coalesce(seconds - F.lag(seconds).over(by) >= gap_seconds, F.lit(False)).cast("int")
    return frames.withColumn("new", apart).withColumn("session_id", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new")


def _plain(value):
    """Rows in a state's value as tuples: the client writes back no Row that it has read."""
    return [_plain(v) for v in value] if isinstance(value, list) else tuple(map(_plain, value)) if isinstance(value, tuple) else value


class _PerCamera(StatefulProcessor):
    """What the processors share. A key is a group of cameras, and its state one value: of each camera the time of the newest frame taken (microseconds), a count, and what else a processor holds. Every call for state is a round trip, so a batch makes one to read and one to write for a whole group.
    One timer a group, at the earliest end of a camera; it ends those that are idle by then and is set anew for the next."""

    #: More fields of a camera's state, and the columns it is fed with (at: ts in microseconds).
    MORE, READS = "", ["frame_id", "at"]

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cameras", f"timer long, cameras array<struct<camera: long, last: long, n: int{self.MORE}>>")

    def take(self, camera: int | None, held: tuple | None, *columns: list) -> tuple[tuple, list]:
        """From a camera's state (last, n, more; None at first) and its frames, in order: the new state, and output."""
        raise NotImplementedError

    def output(self, frames: pd.DataFrame, found: list) -> pd.DataFrame:
        raise NotImplementedError

    def before(self) -> tuple[int | None, dict[int | None, tuple]]:
        timer, cameras = self.state.get() or (None, [])
        return timer, {camera: tuple(held) for camera, *held in _plain(cameras)}

    def after(self, timer: int | None, cameras: dict[int | None, tuple]) -> None:
        ends = min(last for last, *_ in cameras.values()) // 1000 + self.idle_ms
        wanted = ends if timer is None else min(timer, ends)
        self.state.update((wanted, [(camera, *held) for camera, held in cameras.items()]))
        if wanted != timer:  # it may go off too early, never too late
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, cameras = self.before()
        frames = pd.concat(list(rows)).sort_values(["camera", "ts", "frame_id"])
        whose = [None if pd.isna(camera) else int(camera) for camera in frames["camera"].tolist()]
        fed = {"at": frames["ts"].dt.as_unit("us").astype("int64")}
        columns = [fed.get(c, frames.get(c)).tolist() for c in self.READS]
        found = []
        for camera, places in groupby(range(len(whose)), key=whose.__getitem__):
            first = next(places)
            of = slice(first, first + 1 + sum(1 for _ in places))
            cameras[camera], some = self.take(camera, cameras.get(camera), *(c[of] for c in columns))
            found += some
        self.after(timer, cameras)
        yield self.output(frames, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, (_, cameras) = timerValues.getCurrentWatermarkInMs(), self.before()
        live = {camera: held for camera, held in cameras.items() if held[0] // 1000 + self.idle_ms > now}
        if live:
            self.after(None, live)
        else:
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class _Judge(_PerCamera):
    #: Frames kept within the lateness, with their time.
    MORE = ", seen array<struct<frame_id: string, at: long>>"

    def __init__(self, lateness_ms: int, idle_ms: int):
        super().__init__(idle_ms)
        self.lateness = 1000 * lateness_ms

    def take(self, camera, held, frame_ids, times) -> tuple[tuple, list]:
        last, _, kept = held or (None, 0, [])
        oldest = None if last is None else last - self.lateness
        seen = {frame_id: at for frame_id, at in kept if at >= oldest}
        verdicts = []
        for frame_id, at in zip(frame_ids, times):
            if oldest is not None and at < oldest:
                verdicts.append("late")
            elif frame_id in seen:
                verdicts.append("repeated")
            else:
                seen[frame_id] = at
                verdicts.append("kept")
        return (times[-1] if last is None else max(last, times[-1]), 0, list(seen.items())), verdicts

    def output(self, frames, found) -> pd.DataFrame:
        return frames[["camera", "frame_id", "ts"]].assign(verdict=found)


class _Cutter(_PerCamera):
    def __init__(self, gap_ms: int, idle_ms: int):
        super().__init__(idle_ms)
        self.gap = 1000 * gap_ms

    def take(self, camera, held, frame_ids, times) -> tuple[tuple, list]:
        last, session = held or (None, -1)
        sessions = []
        for at in times:
            if last is not None and at < last:
                sessions.append(None)
                continue
            session += last is None or at - last >= self.gap
            sessions.append(session)
            last = at
        return (last, session), sessions

    def output(self, frames, found) -> pd.DataFrame:
        return frames[["camera", "frame_id", "ts"]].assign(session_id=pd.array(found, "Int32"))


class _Tracker(_PerCamera):
    MORE = ", live array<struct<id: int, cx: double, cy: double, w: double, h: double, streak: int, misses: int, done: boolean>>, born int"
    READS = ["frame_id", "at", "ts", "detections"]

    def __init__(self, min_iou: float, max_misses: int, min_consecutive: int, min_confidence: float, idle_ms: int):
        super().__init__(idle_ms)
        self.rules = (min_iou, max_misses)
        self.least, self.sure = min_consecutive, min_confidence

    def take(self, camera, held, frame_ids, times, stamps, detections) -> tuple[tuple, list]:
        linker, done, (last, n, live, born) = Linker(*self.rules), set(), held or (None, -1, [], 0)
        linker.born = born
        for t in live:
            linker.live.append({"id": t[0], "box": tuple(t[1:5]), "streak": t[5], "misses": t[6]})
            done |= {t[0]} if t[7] else set()
        out = []
        for frame_id, at, ts, found in zip(frame_ids, times, stamps, detections):
            if last is not None and at < last:
                out.append((camera, "late", None, frame_id, ts, None))
                continue
            last, n = at, n + 1
            boxes = [(d["cx"], d["cy"], d["w"], d["h"]) for d in found if d["confidence"] >= self.sure]
            for track, _, streak, _ in sorted(linker.step(boxes)["hits"]):
                if streak >= self.least and track not in done:
                    done.add(track)
                    out.append((camera, "confirmed", track, frame_id, ts, n))
        tracks = [(t["id"], *t["box"], t["streak"], t["misses"], t["id"] in done) for t in linker.live]
        return (last, n, tracks, linker.born), out

    def output(self, frames, found) -> pd.DataFrame:
        rows = pd.DataFrame(found, columns=["camera", "kind", "track_id", "frame_id", "ts", "frame_idx"])
        return rows.astype({"track_id": "Int32", "frame_idx": "Int32"})


def _by_camera(frames: DataFrame, processor: StatefulProcessor, schema: str, idle: str, groups: int) -> DataFrame:
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    dealt = frames.withColumn("camera_group", F.pmod(F.xxhash64("camera"), F.lit(groups)))
    return dealt.withWatermark("ts", idle).groupBy("camera_group").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def milliseconds(span: str) -> int:
    """Of a span such as '10 minutes' or '2 days'."""
    return int(pd.Timedelta(span) / pd.Timedelta(milliseconds=1))


def judged_stream(frames: DataFrame, lateness: str, idle: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """All frames with a verdict: late (older than the newest of its camera in earlier batches by more than `lateness`), repeated (its id was kept within that time), kept. camera, frame_id, ts, verdict."""
    return _by_camera(frames.select("camera", "frame_id", "ts"), _Judge(milliseconds(lateness), milliseconds(idle)), VERDICTS, idle, groups)


def session_stream(frames: DataFrame, gap: str, idle: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """All frames with their session: session_id from 0 in each camera; a frame `gap` or more after the last begins a new one, one older than the last taken is late and has none. camera, frame_id, ts, session_id."""
    return _by_camera(frames.select("camera", "frame_id", "ts"), _Cutter(milliseconds(gap), milliseconds(idle)), SESSIONS, idle, groups)


def track_stream(frames: DataFrame, min_iou: float, max_misses: int, min_consecutive: int, min_confidence: float = 0.0, idle: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """Confirmations, each track's once (kind confirmed), and late frames (kind late: older than the last one taken, not tracked): camera, kind, track_id, frame_id, ts, frame_idx (of the camera's frames since its state began)."""
    return _by_camera(frames, _Tracker(min_iou, max_misses, min_consecutive, min_confidence, milliseconds(idle)), CONFIRMATIONS, idle, groups)
