"""Streams give what the batch operators give on the same frames; late, repeated and idle ones by plain rules. Every arrival starts from the checkpoint of the one before."""

import datetime as dt
import random

import pandas as pd
import pytest

from seqlens.operators import tracking
from seqlens.plans.streams import streamed
from seqlens.streaming import cameras

FRAMES = "camera long, frame_id string, ts timestamp, detections array<struct<det_idx: int, cx: double, cy: double, w: double, h: double, confidence: double>>, arrival int"
T0 = dt.datetime(2024, 1, 1)


def frame(camera, i, arrival, boxes=(), frame_id=None):
    return (camera, frame_id or f"{camera}_{i:03d}", T0 + dt.timedelta(seconds=30 * i), list(boxes), arrival)


def test_stream_tracker_equals_batch(spark):
    rng = random.Random(2)
    rows = [frame(c, i, i // 4, [(j, rng.random(), 0.5, 0.3, 0.3, 0.9) for j in range(rng.choice([0, 1, 2]))]) for c in range(3) for i in range(15)]
    late = [frame(1, 3, 2, [(0, 0.1, 0.5, 0.3, 0.3, 0.9)], "late"), frame(9, 0, 3)]
    found = streamed(spark, spark.createDataFrame(rows + late, FRAMES), lambda s: cameras.track_stream(s, 0.2, 1, 2)).collect()
    long = [(c, i, b[0] if b else None, *(b[1:] if b else [None] * 5)) for c in range(3) for i, r in enumerate([x for x in rows if x[0] == c]) for b in (r[3] or [None])]
    batch = tracking.confirmations(tracking.link(spark.createDataFrame(long, "sequence_id long, frame_idx int, det_idx int, cx double, cy double, w double, h double, confidence double"), 0.2, 1), 2)
    assert sorted((r.camera, r.track_id, r.frame_idx) for r in found if r.kind == "confirmed") == sorted((r.sequence_id, r.track_id, r.confirmed_at) for r in batch.collect())
    assert [(r.camera, r.frame_id, r.track_id) for r in found if r.kind == "late"] == [(1, "late", None)]


def test_verdicts_and_sessions(spark):
    order = [[0, 1, 2, 2], [3, 10, 1], [11, 2, 12], [4, 30]]  # seconds / 30 by arrival; 2 comes three times
    rows = [frame(c, i, a) for c in (1, 2) for a, some in enumerate(order) for i in some]
    frames = spark.createDataFrame(rows, FRAMES)
    judged = streamed(spark, frames, lambda s: cameras.judged_stream(s, "4 minutes"))
    got = sorted((int(r.frame_id[-3:]), r.verdict) for r in judged.where("camera = 1").collect())
    # newest before each arrival: none, 2, 10, 12; 4 minutes are 8 places
    assert got == sorted([(0, "kept"), (1, "kept"), (2, "kept"), (2, "repeated"), (3, "kept"), (10, "kept"), (1, "repeated"), (11, "kept"), (2, "repeated"), (12, "kept"), (4, "kept"), (30, "kept")])
    tight = streamed(spark, frames, lambda s: cameras.judged_stream(s, "1 minute"))
    assert sorted(int(r.frame_id[-3:]) for r in tight.where("camera = 2 and verdict = 'late'").collect()) == [2, 4]
    cut = streamed(spark, frames, lambda s: cameras.session_stream(s, "2 minutes"))
    assert sorted((int(r.frame_id[-3:]), r.session_id) for r in cut.where("camera = 1 and session_id is not null").collect()) == [(0, 0), (1, 0), (2, 0), (2, 0), (3, 0), (10, 1), (11, 1), (12, 1), (30, 2)]
    assert sorted(int(r.frame_id[-3:]) for r in cut.where("camera = 1 and session_id is null").collect()) == [1, 2, 4]


def test_idle_cameras_lose_their_state(spark):
    """Camera 2 drives the watermark on while camera 1 is silent; its session counter then starts anew."""
    rows = [frame(1, 0, 0), frame(2, 0, 0), frame(2, 400, 1), frame(2, 800, 2), frame(1, 900, 3), frame(2, 900, 3)]
    cut = streamed(spark, spark.createDataFrame(rows, FRAMES), lambda s: cameras.session_stream(s, "1 minute", idle="1 hour"))
    got = sorted((r.camera, int(r.frame_id[-3:]), r.session_id) for r in cut.collect())
    assert got[:2] == [(1, 0, 0), (1, 900, 0)]
    kept = streamed(spark, spark.createDataFrame(rows, FRAMES), lambda s: cameras.session_stream(s, "1 minute", idle="10 days"))
    assert sorted((r.camera, int(r.frame_id[-3:]), r.session_id) for r in kept.collect())[:2] == [(1, 0, 0), (1, 900, 1)]


def test_repeated_frames_pass_once(spark):
    rows = [frame(1, i % 5, i // 5) for i in range(10)]
    found = streamed(spark, spark.createDataFrame(rows, FRAMES), lambda s: cameras.deduplicated(s, "10 minutes").select("camera", "frame_id"))
    assert sorted(r.frame_id for r in found.collect()) == [f"1_{i:03d}" for i in range(5)]


def test_spans():
    assert cameras.milliseconds("10 minutes") == 600_000
    with pytest.raises(ValueError):
        cameras.milliseconds("soon")


@pytest.mark.parametrize("processor", [cameras._Judge(60_000, 1000), cameras._Cutter(60_000, 1000), cameras._Tracker(0.2, 1, 2, 0.0, 1000)])
def test_a_batch_reads_and_writes_state_once(processor):
    """Every call for state is a round trip to the JVM, so their number mustn't grow with the frames."""
    calls, held = [], {}

    class Handle:
        def getValueState(self, name, schema):
            self.name = name
            return self

        def get(self):
            calls.append("get")
            return held.get(self.name)

        def update(self, value):
            calls.append("update")
            held[self.name] = value

        def registerTimer(self, at):
            calls.append("timer")

    processor.init(Handle())
    batch = pd.DataFrame({"camera": 1, "frame_id": [f"{i}" for i in range(50)], "ts": [pd.Timestamp(T0) + pd.Timedelta(seconds=i) for i in range(50)], "detections": [[]] * 50})
    for _ in range(2):
        list(processor.handleInputRows((1,), iter([batch]), None))
    assert calls == ["get", "update", "timer", "get", "update"]


def test_cameras_of_a_group_share_a_state_value():
    """Round trips mustn't grow with the cameras either; each has its own sessions, and the one timer of a group ends those that are idle."""
    calls, held = [], []

    class Handle:
        now = 1_000_000

        def getValueState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return held[-1] if held else None

        def update(self, value):
            calls.append("update")
            held.append(value)

        def clear(self):
            calls.append("clear")
            held.clear()

        def registerTimer(self, at):
            calls.append(at)

        def deleteTimer(self, at):
            calls.append(-at)

        def getCurrentWatermarkInMs(self):
            return self.now

    processor, handle = cameras._Cutter(60_000, 1000), Handle()
    processor.init(handle)

    def sent(*rows):
        calls.clear()
        batch = pd.DataFrame([(c, str(s), pd.Timestamp(s, unit="s")) for c, s in rows], columns=["camera", "frame_id", "ts"])
        out = pd.concat(list(processor.handleInputRows((0,), iter([batch]), None)))
        return [(r.camera, int(r.frame_id), r.session_id) for r in out.astype({"session_id": object}).itertuples()]

    assert sent((7, 0), (2**53 + 1, 500), (7, 100), (2**53 + 1, 510), (7, 70)) == [(7, 0, 0), (7, 70, 1), (7, 100, 1), (2**53 + 1, 500, 0), (2**53 + 1, 510, 0)]
    assert calls == ["get", "update", 101_000]
    # an older camera comes in: the timer is set back; what is older than the last taken is late
    assert sent((8, 40), (2**53 + 1, 505), (7, 200)) == [(7, 200, 2), (8, 40, 0), (2**53 + 1, 505, pd.NA)]
    assert calls == ["get", "update", -101_000, 41_000]
    calls.clear()
    handle.now = 201_000
    assert not list(processor.handleExpiredTimer((0,), handle, None))
    assert calls == ["get", "update", 511_000]
    assert sent((7, 520), (2**53 + 1, 600)) == [(7, 520, 0), (2**53 + 1, 600, 1)]
    calls.clear()
    handle.now = 601_000
    assert not list(processor.handleExpiredTimer((0,), handle, None))
    assert calls == ["get", "clear"]


@pytest.mark.parametrize("groups", [1, 1024])
def test_idle_cameras_of_one_group(spark, groups):
    rows = [frame(1, 0, 0), frame(2, 0, 0), frame(2, 400, 1), frame(2, 800, 2), frame(1, 900, 3), frame(2, 900, 3)]
    cut = streamed(spark, spark.createDataFrame(rows, FRAMES), lambda s: cameras.session_stream(s, "1 minute", idle="1 hour", groups=groups))
    assert sorted((r.camera, int(r.frame_id[-3:]), r.session_id) for r in cut.collect()) == [(1, 0, 0), (1, 900, 0), (2, 0, 0), (2, 400, 1), (2, 800, 2), (2, 900, 3)]


def test_silent_cameras_of_a_group_keep_their_state(spark):
    """One group: camera 1 sends in the first and last arrival only, so what it holds is read and written back in between."""
    box = [(0, 0.5, 0.5, 0.3, 0.3, 0.9)]
    rows = [frame(1, 0, 0, box), frame(2, 0, 0, box), frame(2, 1, 1, box), frame(1, 2, 2, box), frame(2, 2, 2, box)]
    tracked = streamed(spark, spark.createDataFrame(rows, FRAMES), lambda s: cameras.track_stream(s, 0.2, 1, 2, groups=1)).collect()
    assert sorted((r.camera, r.kind, r.frame_id) for r in tracked) == [(1, "confirmed", "1_002"), (2, "confirmed", "2_001")]
    judged = streamed(spark, spark.createDataFrame([*rows, frame(1, 0, 2, box)], FRAMES), lambda s: cameras.judged_stream(s, "10 minutes", groups=1)).collect()
    assert sorted((r.camera, r.frame_id, r.verdict) for r in judged if r.camera == 1) == [(1, "1_000", "kept"), (1, "1_000", "repeated"), (1, "1_002", "kept")]
