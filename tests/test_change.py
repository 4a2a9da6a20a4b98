"""Summed-area tables, augmentation and window sums against plain versions."""

import functools
import operator
import random

import pytest

from seqlens.operators import change, shape, smoothing

RASTERS = "sequence_id long, frame_idx int, height int, width int, px array<int>"
BOXES = "sequence_id long, frame_idx int, det_idx int, cx double, cy double, w double, h double, confidence double, note string"


def test_ratios_of_a_thousand_boxes_a_frame(spark):
    rng = random.Random(1)
    height, width = 30, 40
    frames = [(1, f, height, width, [rng.randrange(256) for _ in range(height * width)]) for f in range(3)]
    frames += [(2, 0, 2, 2, [0] * 4), (2, 1, 2, 2, [9, 0, 0, 0]), (3, 0, 2, 2, [0] * 4), (3, 1, 1, 4, [9] * 4), (4, 0, 2, 2, None), (4, 1, 2, 2, [1] * 4)]
    boxes = [(s, f, d, rng.uniform(-0.2, 1.2), rng.uniform(-0.2, 1.2), rng.uniform(0, 0.8), rng.uniform(0, 0.8), 0.5, f"n{d}") for s, f, n in ((1, 0, 2), (1, 1, 1000), (1, 2, 1000), (2, 1, 3), (3, 1, 1), (4, 1, 1), (9, 0, 1)) for d in range(n)]
    boxes.append((2, 1, 7, 0.25, 0.25, 0.5, 0.5, 0.5, None))
    got = {(r.sequence_id, r.frame_idx, r.det_idx, r.pixel_threshold): r.change_ratio for r in change.change_ratios(spark.createDataFrame(frames, RASTERS), spark.createDataFrame(boxes, BOXES), [0, 60, 200]).collect()}
    assert len(got) == 3 * len(boxes)
    pixels = {(s, f): (h, w, px) for s, f, h, w, px in frames}
    for s, f, d, cx, cy, w, h, _, _ in boxes:
        one, two = pixels.get((s, f - 1)), pixels.get((s, f))
        for t in (0, 60, 200):
            if not one or not two or one[:2] != two[:2] or one[2] is None:
                assert got[s, f, d, t] is None
                continue
            high, wide, px = two
            x0, y0 = max(0, int((cx - w / 2) * wide)), max(0, int((cy - h / 2) * high))
            x1, y1 = min(wide, int((cx + w / 2) * wide)), min(high, int((cy + h / 2) * high))
            inside = [abs(px[y * wide + x] - one[2][y * wide + x]) > t for y in range(y0, y1) for x in range(x0, x1)]
            assert got[s, f, d, t] == pytest.approx(sum(inside) / len(inside) if inside else 0.0)
    assert got[2, 1, 7, 0] == 1.0


def test_augmentation_rules(spark):
    rows = [(t, t % 3, f, f % 4 == 1) for t in range(400) for f in range(t % 13 + 1)]
    entries = spark.createDataFrame(rows, "sequence_id long, tube_id int, frame_idx int, is_gap boolean")
    run = lambda **more: {k: [(r.slot, r.frame_idx) for r in v] for k, v in _grouped(shape.augment(entries, 5, **more).collect()).items()}
    whole = run(p_sub=0, p_stride=0, p_drop=0)
    assert all([f for _, f in v] == list(range(k % 13 + 1)) and [s for s, _ in v] == list(range(len(v))) for k, v in whole.items())
    cut = run(p_sub=1, p_stride=0, p_drop=0, min_sub=3)
    assert all([f for _, f in v] == list(range(v[0][1], v[0][1] + len(v))) and len(v) >= min(3, k % 13 + 1) for k, v in cut.items())
    assert {len(v) for k, v in cut.items() if k % 13 == 12} == set(range(3, 14))  # every length from the least to all
    strided = run(p_sub=0, p_stride=1, p_drop=0)
    assert all([f for _, f in v] == (list(range(0, k % 13 + 1, 2)) if k % 13 > 1 else list(range(k % 13 + 1))) for k, v in strided.items())
    dropped = run(p_sub=0, p_stride=0, p_drop=0.9, min_kept=5)
    assert all(len(v) >= min(5, k % 13 + 1) for k, v in dropped.items()) and {v[0][1] for k, v in dropped.items() if k % 13 == 12} > {0, 1}
    assert run() == run() and run() != run(epoch=1)


def _grouped(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.slot)):
        found.setdefault(r.sequence_id, []).append(r)
    return found


def test_windows_of_one_join(spark):
    rng = random.Random(8)
    rows = [(s, f, d, rng.random(), 0.5, 0.3, 0.3, rng.random()) for s in range(3) for f in range(12) if rng.random() < 0.8 for d in range(rng.randint(1, 3))]
    detections = spark.createDataFrame(rows, "sequence_id long, frame_idx int, det_idx int, cx double, cy double, w double, h double, confidence double")
    got = {(r.sequence_id, r.frame_idx, r.window): r.smoothed for r in smoothing.smoothed_windows(detections, [1, 4, 6]).collect()}
    for n in (1, 4, 6):
        for s, f in {r[:2] for r in rows}:
            sums = [sum(p[7] for p in rows if p[0] == s and f - n < p[1] <= f and abs(p[3] - r[3]) < 0.3) for r in rows if r[:2] == (s, f)]
            assert got[s, f, n] == pytest.approx(max(sums) / (n + 1))


def test_sums_of_windows_are_added_in_one_order(spark):
    """Newest frame first, then by box, however the rows are dealt: sums in doubles depend on the order."""
    conf = [0.1, 0.7, 0.3, 1e16, 0.2, -1e16, 0.9, 0.6]
    rows = [(s, f, d, 0.5, 0.5, 0.3, 0.3, conf[2 * f + d]) for s in range(30) for f in range(4) for d in range(2)]
    detections = spark.createDataFrame(rows, "sequence_id long, frame_idx int, det_idx int, cx double, cy double, w double, h double, confidence double").repartition(7, "confidence")
    want = functools.reduce(operator.add, [conf[2 * f + d] for f in (3, 2, 1, 0) for d in range(2)]) / 5
    assert {r.smoothed for r in smoothing.smoothed_windows(detections, [4]).where("frame_idx = 3").collect()} == {want}


def test_mean_pool_over_a_mask(spark):
    rows = [(1, [1.0, 2.0], True), (1, [3.0, 6.0], True), (1, [9.0, 9.0], False), (2, [5.0, 5.0], False)]
    got = shape.mean_pool(spark.createDataFrame(rows, "k int, embedding array<float>, seen boolean"), ["k"], mask="seen").collect()
    assert [(r.k, r.pooled) for r in got] == [(1, [2.0, 4.0])]
