"""Tracker and tubes: literal cases, and a plain version on random sequences."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqlens.functions import geometry
from seqlens.operators import joins, shape, sweep, tracking, tubes

FRAMES = "sequence_id long, frame_idx int, det_idx int, class_id int, cx double, cy double, w double, h double, confidence double"


def long_form(sequences):
    """{id: [[(cx, cy, w, h, conf), ...] for each frame]} as rows, a row of nulls for an empty frame."""
    rows = []
    for s, frames in sequences.items():
        for at, boxes in enumerate(frames):
            rows += [(s, at, j, 0, *b) for j, b in enumerate(boxes)] or [(s, at, None, None, None, None, None, None, None)]
    return rows


def box(x, conf=0.9, size=0.2):
    return (x, 0.5, size, size, conf)


def plain_iou(a, b):
    w = min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2)
    h = min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2)
    inter = max(0, w) * max(0, h)
    union = a[2] * a[3] + b[2] * b[3] - inter
    return inter / union if union > 0 else 0.0


def plain_tracks(frames, min_iou, max_misses, least):
    """Tracks of one sequence, written another way than the kernel: (hits, confirmed_at)."""
    tracks = []
    for at, boxes in enumerate(frames):
        alive = [t for t in tracks if t["misses"] <= max_misses]
        options = [(plain_iou(t["hits"][-1][1], b), i, j) for i, t in enumerate(alive) for j, b in enumerate(boxes)]
        options = [o for o in options if o[0] >= min_iou]
        used_i, used_j = set(), set()
        while options:
            best = max(options, key=lambda o: (o[0], -o[1], -o[2]))
            _, i, j = best
            alive[i]["hits"].append((at, boxes[j]))
            alive[i]["streak"] += 1
            alive[i]["misses"] = 0
            used_i.add(i), used_j.add(j)
            options = [o for o in options if o[1] != i and o[2] != j]
        for i, t in enumerate(alive):
            if i not in used_i:
                t["misses"] += 1
                t["streak"] = 0
        tracks += [{"hits": [(at, b)], "streak": 1, "misses": 0, "at": None} for j, b in enumerate(boxes) if j not in used_j]
        for t in tracks:
            if t["misses"] <= max_misses and t["at"] is None and t["streak"] >= least:
                t["at"] = at
    return [([h[0] for h in t["hits"]], t["at"]) for t in tracks]


@pytest.mark.parametrize(("min_iou", "max_misses", "least"), [(0.1, 0, 2), (0.2, 1, 3), (0.05, 2, 1)])
def test_tracker_like_plain_version(spark, min_iou, max_misses, least):
    rng = random.Random(5)
    sequences = {s: [[(rng.random(), rng.random() / 3 + 0.3, 0.2 + rng.random() / 5, 0.3, rng.random()) for _ in range(rng.choice([0, 1, 2, 3]))] for _ in range(10)] for s in range(12)}
    frames = spark.createDataFrame(long_form(sequences), FRAMES)
    hits = tracking.link(frames, min_iou, max_misses)
    at = {(r.sequence_id, r.track_id): r.confirmed_at for r in tracking.confirmations(hits, least).collect()}
    got = {}
    for r in hits.orderBy("sequence_id", "track_id", "frame_idx").collect():
        got.setdefault((r.sequence_id, r.track_id), []).append(r.frame_idx)
    want = {(s, i): t for s, f in sequences.items() for i, t in enumerate(plain_tracks(f, min_iou, max_misses, least))}
    assert {k: (v, at.get(k)) for k, v in got.items()} == want


def test_gap_resets_the_streak(spark):
    frames = spark.createDataFrame(long_form({1: [[box(0.5)], [box(0.5)], [], [box(0.5)], [box(0.5)]]}), FRAMES)
    rows = tracking.track(frames, 0.1, 1, 3).collect()
    assert len(rows) == 1 and rows[0].confirmed_at is None and not rows[0].confirmed
    assert tracking.track(frames, 0.1, 1, 2).collect()[0].confirmed_at == 1


def test_second_filter_is_skipped_when_the_first_fails(spark):
    frames = spark.createDataFrame(long_form({1: [[box(0.5, 0.2)], [box(0.5, 0.2)]], 2: [[box(0.5, 0.8)], [box(0.5, 0.8)]]}), FRAMES)
    rows = {r.sequence_id: r for r in tracking.track(frames, 0.1, 0, 2, 0.5, 1.2).collect()}
    assert [f["filter"] for f in rows[1].filters] == ["confidence"] and not rows[1].confirmed
    assert [f["filter"] for f in rows[2].filters] == ["confidence", "area_change"] and not rows[2].confirmed
    alarm = tracking.alarms(tracking.track(frames, 0.1, 0, 2, 0.5), frames.select("sequence_id").distinct())
    assert {r.sequence_id: r.trigger_frame_index for r in alarm.collect()} == {1: None, 2: 1}


def test_trace(spark):
    frames = spark.createDataFrame(long_form({1: [[box(0.2)], [box(0.2), box(0.8)], [box(0.8)], []]}), FRAMES)
    rows = tracking.trace(frames, 0.1, 0).orderBy("frame_idx").collect()
    assert [r.new_ids for r in rows] == [[0], [1], [], []]
    assert [r.missed_ids for r in rows] == [[], [], [0], [1]]
    assert [r.pruned_ids for r in rows] == [[], [], [0], [1]]
    assert [m.track_id for m in rows[1].matches] == [0]


def test_greedy_matching_native(spark):
    pairs = spark.createDataFrame([("a", 0, 0, 0.5), ("a", 0, 1, 0.9), ("a", 1, 1, 0.8), ("a", 1, 0, 0.3), ("b", 0, 0, 0.4), ("b", 0, 1, 0.4)], "k string, prev_idx int, det_idx int, iou double")
    got = {(r.k, r.prev_idx, r.det_idx) for r in joins.greedy_matches(pairs, ["k"]).collect()}
    assert got == {("a", 0, 1), ("a", 1, 0), ("b", 0, 0)}


def test_tube_gaps_and_end(spark):
    frames = spark.createDataFrame(long_form({1: [[box(0.5)], [], [box(0.6)], [], [], [], [box(0.5)]]}), FRAMES)
    entries = tubes.build(frames, 0.1, 2)
    rows = [(r.tube_id, r.frame_idx, r.is_gap) for r in entries.orderBy("tube_id", "frame_idx").collect()]
    assert rows == [(0, 0, False), (0, 1, True), (0, 2, False), (1, 6, False)]
    filled = tubes.interpolate(entries).where("frame_idx = 1").collect()[0]
    assert math.isclose(filled.cx, 0.55) and filled.confidence == 0.0 and filled.class_id == 0
    again = tubes.entries_of(tubes.records(tubes.interpolate(entries)))
    assert again.count() == 4


def test_boundary_gap_repeats(spark):
    entries = spark.createDataFrame([(1, 0, 0, None, None, None, None, None, None, True), (1, 0, 1, 2, 0.5, 0.4, 0.2, 0.1, 0.9, False)], "sequence_id long, tube_id int, frame_idx int, class_id int, cx double, cy double, w double, h double, confidence double, is_gap boolean")
    row = tubes.interpolate(entries).where("frame_idx = 0").collect()[0]
    assert (row.cx, row.h, row.class_id, row.confidence) == (0.5, 0.1, 2, 0.0)


def test_first_crossing_earliest_then_smallest(spark):
    rows = [(1, t, p, p - 1, float(v)) for t, ls in {0: [0, 0, 0, 1, 1], 1: [0, 0, 1, 1, 1], 2: [0, 0, 1, 1, 1], 3: [1, 1, 1, 1, 0]}.items() for p, v in enumerate(ls, 1)]
    prefixes = spark.createDataFrame(rows, "sequence_id long, tube_id int, prefix int, frame_idx int, logit double")
    crossed, triggers = tubes.first_crossing(prefixes, 2, F.col("logit") >= 1)
    assert {r.tube_id: (r.crossing_frame, r.prefix_length) for r in crossed.collect()} == {0: (3, 4), 1: (2, 3), 2: (2, 3)}
    assert [(r.trigger_frame_index, r.trigger_tube_id) for r in triggers.collect()] == [(2, 1)]


def test_padding(spark):
    frames = spark.createDataFrame([(1, 0, "f1"), (1, 1, "f2")], "sequence_id long, frame_idx int, frame_id string")
    got = [r.frame_id for r in shape.pad_symmetric(frames, 5).orderBy("slot").collect()]
    assert got == ["f1", "f1", "f1", "f2", "f2"]
    got = [(r.frame_id, r.is_padded) for r in shape.pad_uniform(frames, 5).orderBy("slot").collect()]
    assert got == [("f1", False), ("f1", True), ("f1", True), ("f2", False), ("f2", True)]


def test_iou_and_rounding(spark):
    rows = spark.createDataFrame([(0.5, 0.5, 0.2, 0.2, 0.5, 0.5, 0.2, 0.2), (0.1, 0.1, 0.1, 0.1, 0.9, 0.9, 0.1, 0.1), (0.5, 0.5, 0.0, 0.0, 0.5, 0.5, 0.0, 0.0)], "cx double, cy double, w double, h double, ocx double, ocy double, ow double, oh double")
    got = [r[0] for r in rows.select(geometry.iou(geometry.box(), tuple(F.col(f"o{c}") for c in ("cx", "cy", "w", "h")))).collect()]
    assert math.isclose(got[0], 1.0) and got[1:] == [0.0, 0.0]
    x0, *_ = geometry.pixel_square("cx", "cy", "w", "h", 10, 10)
    assert spark.createDataFrame([(0.35, 0.5, 0.2, 0.2)], "cx double, cy double, w double, h double").select(x0).first()[0] == 2


def test_sweep_equals_single_runs(spark):
    rng = random.Random(3)
    sequences = {s: [[(rng.random(), 0.5, 0.3, 0.3, rng.random()) for _ in range(rng.choice([0, 1, 2]))] for _ in range(8)] for s in range(10)}
    frames = spark.createDataFrame(long_form(sequences), FRAMES)
    truth = spark.createDataFrame([(s, s % 2 == 0) for s in sequences], "sequence_id long, is_positive_gt boolean")
    rows = sweep.tracker_sweep(frames, truth).collect()
    assert len(rows) == 1 * 1 * 2 * 2 * 5 * 2 * 2
    for r in [x for x in rows if x.min_consecutive in (1, 2)][:6]:
        kept = {s: [[b for b in f if b[4] >= r.confidence] for f in fs] for s, fs in sequences.items()}
        alarm = tracking.alarms(tracking.track(spark.createDataFrame(long_form(kept), FRAMES), r.iou, r.max_misses, r.min_consecutive, r.min_mean_confidence, r.min_area_change), truth)
        assert alarm.where("is_positive and is_positive_gt").count() == r.tp
        assert alarm.where("is_positive and not is_positive_gt").count() == r.fp


def test_grids_have_the_published_sizes():
    size = lambda grid: __import__("math").prod(map(len, grid.values()))
    assert size(sweep.BASE) == 150 and size(sweep.WHOLE) == 28_800
    assert all(set(sweep.BASE[k]) <= set(sweep.EACH[k]) <= set(sweep.WHOLE[k]) for k in sweep.WHOLE)
    assert sweep.WHOLE["max_area"] == [None, 0.05, 0.1, 0.15] and sweep.WHOLE["min_area_change"] == [None, 1.0, 1.1, 1.2]


def test_one_pass_over_batches_of_any_size(spark):
    """Frames and sequences that lie across batches, ids of another type, extra columns: the same hits, and gaps between them."""
    import random

    rng = random.Random(4)
    rows = []
    for s in range(9):
        for f in range(rng.choice([1, 40])):
            dets = [(f"c{s}", f, d, 0.2 * d + rng.random() / 20, 0.5, 0.1, 0.1, rng.random(), 7) for d in range(rng.randint(0, 4))]
            rows += dets or [(f"c{s}", f, None, None, None, None, None, None, None)]
    frames = spark.createDataFrame(rows, "sequence_id string, frame_idx int, det_idx int, cx double, cy double, w double, h double, confidence double, class_id int")
    key = lambda r: tuple((x is not None, x) for x in r)
    found = []
    for size in ("1", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(sorted(map(tuple, tracking.linked(frames, 0.2, 2, gaps=True).collect()), key=key))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == found[2]
    by_key = {r[:3]: r for r in rows if r[2] is not None}
    plain = {}
    for s in sorted({r[0] for r in rows}):
        linker = tracking.Linker(0.2, 2)
        for f in range(1 + max(r[1] for r in rows if r[0] == s)):
            here = sorted(r for r in rows if r[:2] == (s, f) and r[2] is not None)
            for t, j, streak, _ in linker.step([r[3:7] for r in here])["hits"]:
                plain[s, t, f] = (here[j][2], streak)
    assert {(r[0], r[1], r[2]): (r[3], r[-2]) for r in found[0] if r[3] is not None} == plain
    assert all(r[4:10] == ((*by_key[r[0], r[2], r[3]][3:7], 7, by_key[r[0], r[2], r[3]][7]) if r[3] is not None else (None,) * 6) for r in found[0])
    for s, t in {k[:2] for k in plain}:
        ats = sorted(f for a, b, f in plain if (a, b) == (s, t))
        assert sorted(r[2] for r in found[0] if r[:2] == (s, t)) == list(range(ats[0], ats[-1] + 1))


def test_one_kernel_in_the_plan(spark):
    frames = spark.createDataFrame(long_form({}), FRAMES)
    for df in (tracking.track(frames, 0.1, 1, 3, 0.4, 1.1), tubes.build(frames)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan
