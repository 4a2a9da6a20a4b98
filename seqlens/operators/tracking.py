"""Tracking detections over frames, confirmation and post-filters.

A camera sequence is the unit of work. Rows are dealt by sequence and sorted inside partitions, and one kernel passes over them frame by frame: it holds the open tracks of one sequence and one frame's boxes, however long the sequence is. Hits leave it with the columns of their detection, so nothing is joined back; everything computed from a track is native.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import geometry


def box_iou(a: tuple, b: tuple) -> float:
    """Of two boxes (cx, cy, w, h) in Python, for kernels."""
    across = min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2)
    down = min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2)
    both = max(0.0, across) * max(0.0, down)
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union > 0 else 0.0


def match(old: list[tuple], new: list[tuple], min_iou: float) -> dict[int, tuple[int, float]]:
    """Greedy one-to-one matching, best overlap first, ties by position: old to (new, iou)."""
    ranked = sorted((-v, i, j) for i, a in enumerate(old) for j, b in enumerate(new) if (v := box_iou(a, b)) >= min_iou)
    taken: dict[int, tuple[int, float]] = {}
    used: set[int] = set()
    for minus, i, j in ranked:
        if i not in taken and j not in used:
            taken[i] = (j, -minus)
            used.add(j)
    return taken


class Linker:
    """Links boxes frame by frame. A track lives while it has missed at most max_misses frames in a row; a miss ends its streak of hits."""

    def __init__(self, min_iou: float, max_misses: int):
        self.min_iou, self.max_misses = min_iou, max_misses
        self.live: list[dict] = []
        self.born = 0

    def step(self, boxes: list[tuple]) -> dict:
        """One frame. Returns hits as (track, box, streak, iou), and the ids born, missed and pruned."""
        old = [t["box"] for t in self.live]
        found = match(old, boxes, self.min_iou) if old and boxes else {}
        hits, missed = [], []
        for i, track in enumerate(self.live):
            if i in found:
                j, iou = found[i]
                track.update(box=boxes[j], streak=track["streak"] + 1, misses=0)
                hits.append((track["id"], j, track["streak"], iou))
            else:
                track.update(streak=0, misses=track["misses"] + 1)
                missed.append(track["id"])
        born = []
        matched = {j for j, _ in found.values()}
        for j, box in enumerate(boxes):
            if j not in matched:
                self.live.append({"id": self.born, "box": box, "streak": 1, "misses": 0})
                hits.append((self.born, j, 1, None))
                born.append(self.born)
                self.born += 1
        pruned = [t["id"] for t in self.live if t["misses"] > self.max_misses]
        self.live = [t for t in self.live if t["misses"] <= self.max_misses]
        return {"hits": hits, "born": born, "missed": missed, "pruned": pruned}


TRACE = "n_detections int, matches array<struct<track_id: int, det_idx: int, iou: double>>, new_ids array<int>, missed_ids array<int>, confirmed_ids array<int>, pruned_ids array<int>"


def frames_of(rows: pd.DataFrame) -> Iterator[tuple[int, list[int], list[tuple]]]:
    """Of a sequence in long form (a frame without detections has one row with a null det_idx): frame_idx, det_idx and boxes of each frame in order."""
    rows = rows.sort_values(["frame_idx", "det_idx"], kind="stable")
    at, seen, dets = rows["frame_idx"].tolist(), rows["det_idx"].notna().tolist(), rows["det_idx"].tolist()
    boxes = list(zip(*(rows[c].tolist() for c in ("cx", "cy", "w", "h"))))
    for frame, group in groupby(range(len(at)), key=at.__getitem__):
        here = [i for i in group if seen[i]]
        yield int(frame), [int(dets[i]) for i in here], [boxes[i] for i in here]


def by_sequence(rows: DataFrame, partitions: int | None = None, more: list[str] | None = None) -> DataFrame:
    """rows dealt by sequence (and more columns) over so many partitions, twice the shuffle partitions by default (the setting that is raised with the data).

    Kernels cost time by row, not by byte: partitions of a given number aren't merged for being small, as those of an aggregate are, and with another number than an aggregate's the step isn't taken for a needless one."""
    return rows.repartition(partitions or 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sequence_id", *(more or []))


def whole_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple]]]:
    """Of batches sorted by sequence_id, frame_idx and det_idx (the first columns): parts that end with a frame, and of each of their frames (sequence_id, frame_idx, places of its detections)."""

    def framed(part: pa.Table) -> tuple[pa.Table, list[tuple]]:
        keys = zip(part.column(0).to_pylist(), part.column(1).to_pylist())
        seen = part.column(2).is_valid().to_pylist()
        return part, [(*key, [i for i, _ in group if seen[i]]) for key, group in groupby(enumerate(keys), key=lambda x: x[1])]

    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not part.num_rows:
            continue
        key = lambda i: (part.column(0)[i].as_py(), part.column(1)[i].as_py())  # noqa: B023, E731
        last, cut = key(part.num_rows - 1), part.num_rows - 1
        while cut and key(cut - 1) == last:
            cut -= 1
        rest = part.slice(cut)
        if cut:
            yield framed(part.slice(0, cut))
    if rest is not None:
        yield framed(rest)


def _sorted(frames: DataFrame, columns: list[str]) -> DataFrame:
    keys = ["sequence_id", "frame_idx", "det_idx"]
    kept = frames.select(*keys, "cx", "cy", "w", "h", *[c for c in columns if c in frames.columns])
    return by_sequence(kept).sortWithinPartitions(*keys)


def linked(frames: DataFrame, min_iou: float, max_misses: int, gaps: bool = False, columns: tuple[str, ...] = ("class_id", "confidence")) -> DataFrame:
    """Hits of all tracks in one pass: sequence_id, track_id, frame_idx, det_idx, the box and `columns` of the detection, streak (hits in a row so far), iou (null at birth). frames: long form with empty frames kept.

    With gaps, a row without a detection for each frame between two hits of a track."""
    rows = _sorted(frames, list(columns))
    carried = rows.columns[3:]
    schema = T.StructType([rows.schema["sequence_id"], T.StructField("track_id", T.IntegerType()), rows.schema["frame_idx"], rows.schema["det_idx"], *[rows.schema[c] for c in carried], T.StructField("streak", T.IntegerType()), T.StructField("iou", T.DoubleType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, linker, last = None, Linker(min_iou, max_misses), {}
        for part, frames in whole_frames(batches):
            boxes = list(zip(*(part.column(c).to_pylist() for c in ("cx", "cy", "w", "h"))))
            out = []
            for key, at, here in frames:
                if key != now:
                    now, linker, last = key, Linker(min_iou, max_misses), {}
                step = linker.step([boxes[i] for i in here])
                for track, j, streak, iou in step["hits"]:
                    if gaps:
                        out += [(key, track, between, None, None, None) for between in range(last.get(track, at) + 1, at)]
                        last[track] = at
                    out.append((key, track, at, here[j], streak, iou))
                for track in step["pruned"]:
                    last.pop(track, None)
            keys, tracks, ats, places, streaks, ious = zip(*out) if out else [()] * 6
            taken = part.take(pa.array(places, pa.int64())).select(["det_idx", *carried])
            kinds = part.schema
            arrays = [pa.array(keys, kinds.field("sequence_id").type), pa.array(tracks, pa.int32()), pa.array(ats, kinds.field("frame_idx").type), *[c.combine_chunks() for c in taken.columns], pa.array(streaks, pa.int32()), pa.array(ious, pa.float64())]
            yield pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema.fieldNames())

    return rows.mapInArrow(kernel, schema)


def link(frames: DataFrame, min_iou: float, max_misses: int) -> DataFrame:
    """Hits of all tracks by their keys: sequence_id, track_id, frame_idx, det_idx, streak, iou."""
    return linked(frames, min_iou, max_misses, columns=()).select("sequence_id", "track_id", "frame_idx", "det_idx", "streak", "iou")


def trace(frames: DataFrame, min_iou: float, max_misses: int, min_consecutive: int = 1) -> DataFrame:
    """What happened in each frame: matches, and ids born, missed, confirmed (min_consecutive hits in a row for the first time) and pruned."""
    rows = _sorted(frames, [])
    schema = T.StructType([rows.schema["sequence_id"], rows.schema["frame_idx"], *T.StructType.fromDDL(TRACE).fields])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, linker, known = None, Linker(min_iou, max_misses), set()
        for part, frames in whole_frames(batches):
            boxes, dets, out = list(zip(*(part.column(c).to_pylist() for c in ("cx", "cy", "w", "h")))), part.column(2).to_pylist(), []
            for key, at, here in frames:
                if key != now:
                    now, linker, known = key, Linker(min_iou, max_misses), set()
                step = linker.step([boxes[i] for i in here])
                matches = [{"track_id": t, "det_idx": dets[here[j]], "iou": v} for t, j, _, v in step["hits"] if v is not None]
                sure = [t for t, _, streak, _ in step["hits"] if streak >= min_consecutive and t not in known]
                known.update(sure)
                known.difference_update(step["pruned"])
                out.append((key, at, len(here), matches, step["born"], step["missed"], sure, step["pruned"]))
            kinds = [part.schema.field(0).type, part.schema.field(1).type, pa.int32(), pa.list_(pa.struct([("track_id", pa.int32()), ("det_idx", pa.int32()), ("iou", pa.float64())])), *[pa.list_(pa.int32())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema.fieldNames())

    return rows.mapInArrow(kernel, schema)


def confirmations(hits: DataFrame, min_consecutive: int) -> DataFrame:
    """First frame at which each track has min_consecutive hits in a row: sequence_id, track_id, confirmed_at."""
    return hits.where(F.col("streak") >= min_consecutive).groupBy("sequence_id", "track_id").agg(F.min("frame_idx").alias("confirmed_at"))


def track_features(hits: DataFrame, detections: DataFrame) -> DataFrame:
    """n_hits, mean_confidence, area_ratio (last to first), first_frame and last_frame of each track."""
    boxes = hits.select("sequence_id", "track_id", "frame_idx", "det_idx").join(detections.select("sequence_id", "frame_idx", "det_idx", "confidence", geometry.area("w", "h").alias("area")), ["sequence_id", "frame_idx", "det_idx"])
    return _features(boxes)


def _features(hits: DataFrame, *more) -> DataFrame:
    found = hits.groupBy("sequence_id", "track_id").agg(F.count("*").alias("n_hits"), F.avg("confidence").alias("mean_confidence"), F.min_by("area", "frame_idx").alias("first"), F.max_by("area", "frame_idx").alias("last"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), *more)
    return found.withColumn("area_ratio", geometry.area_ratio("first", "last")).drop("first", "last")


def post_filter(tracks: DataFrame, min_mean_confidence: float | None = None, min_area_change: float | None = None) -> DataFrame:
    """Confirmed tracks through the confidence and then the area rule (skipped if the first failed): confirmed, confirmed_at and filters, the log of both."""
    confirmed = F.col("confirmed_at").isNotNull()
    sure = F.lit(True) if min_mean_confidence is None else F.col("mean_confidence") >= min_mean_confidence
    grown = F.lit(True) if min_area_change is None else F.col("area_ratio") >= min_area_change
    entry = lambda name, passed, value, limit: F.struct(F.lit(name).alias("filter"), passed.alias("passed"), F.col(value).alias("value"), F.lit(float(limit)).alias("threshold"))
    log = F.array().cast("array<struct<filter: string, passed: boolean, value: double, threshold: double>>")
    if min_mean_confidence is not None:
        log = F.when(confirmed, F.array(entry("confidence", sure, "mean_confidence", min_mean_confidence))).otherwise(log)
    if min_area_change is not None:
        log = F.when(confirmed & sure, F.concat(log, F.array(entry("area_change", grown, "area_ratio", min_area_change)))).otherwise(log)
    return tracks.withColumn("filters", log).withColumn("confirmed", confirmed & sure & grown).withColumn("confirmed_at", F.when(F.col("confirmed"), F.col("confirmed_at")))


def alarms(tracks: DataFrame, sequences: DataFrame) -> DataFrame:
    """Of every sequence: n_tracks, is_positive (any track confirmed), trigger_frame_index (the earliest confirmation)."""
    found = tracks.groupBy("sequence_id").agg(F.count("*").alias("n_tracks"), F.bool_or("confirmed").alias("is_positive"), F.min("confirmed_at").alias("trigger_frame_index"))
    return sequences.join(found, "sequence_id", "left").withColumn("n_tracks", F.coalesce("n_tracks", F.lit(0))).withColumn("is_positive", F.coalesce("is_positive", F.lit(False)))


def track(frames: DataFrame, min_iou: float, max_misses: int, min_consecutive: int, min_mean_confidence: float | None = None, min_area_change: float | None = None) -> DataFrame:
    """All tracks of all sequences, with features, filter log, confirmed and confirmed_at. frames: long form with confidence, empty frames kept."""
    hits = linked(frames, min_iou, max_misses).withColumn("area", geometry.area("w", "h"))
    confirmed = F.min(F.when(F.col("streak") >= min_consecutive, F.col("frame_idx"))).alias("confirmed_at")
    return post_filter(_features(hits, confirmed), min_mean_confidence, min_area_change)


def single_object_runs(frames: DataFrame, min_iou: float) -> DataFrame:
    """The tracker for one box a frame without misses, as windows: the most confident box of each frame, run_id and streak of the run it belongs to.

    A run ends at a frame without a box or where the overlap falls below min_iou. Ties in confidence go to the first box."""
    top = Window.partitionBy("sequence_id", "frame_idx").orderBy(F.desc("confidence"), "det_idx")
    best = frames.where("det_idx is not null").withColumn("nth", F.row_number().over(top)).where("nth = 1").drop("nth")
    by = Window.partitionBy("sequence_id").orderBy("frame_idx")
    past = [F.lag(c).over(by).alias(f"p_{c}") for c in ("frame_idx", "cx", "cy", "w", "h")]
    rows = best.select("*", *past)
    goes_on = (F.col("p_frame_idx") == F.col("frame_idx") - 1) & (geometry.iou(geometry.box("p_"), geometry.box()) >= min_iou)
    rows = rows.withColumn("starts", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("run_id", (F.sum("starts").over(by) - 1).cast("int"))
    return rows.withColumn("streak", F.row_number().over(Window.partitionBy("sequence_id", "run_id").orderBy("frame_idx"))).drop("starts", "p_frame_idx", "p_cx", "p_cy", "p_w", "p_h")


def single_object_alarms(frames: DataFrame, min_iou: float, min_consecutive: int, sequences: DataFrame) -> DataFrame:
    """Of every sequence: is_positive and trigger_frame_index of its single-object runs."""
    runs = single_object_runs(frames, min_iou).where(F.col("streak") >= min_consecutive)
    found = runs.groupBy("sequence_id").agg(F.min("frame_idx").alias("trigger_frame_index"))
    return sequences.join(found, "sequence_id", "left").withColumn("is_positive", F.col("trigger_frame_index").isNotNull())
