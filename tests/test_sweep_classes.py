"""Sweeps by classes of settings against one run of the linker for each setting."""

import random
import tracemalloc
from itertools import product
from statistics import mean, median

import numpy as np
import pytest

from seqlens.operators import sweep

THRESHOLDS = [3, 15, 40]
GRID = sweep.WHOLE | {"min_consecutive": [1, 2, 3]}
CHANGES = sweep.CHANGE | {"pixel_threshold": THRESHOLDS, "min_ratio": [0.01, 0.1], "min_mean_confidence": [None, 0.2]}


def sequences(seed, n=8, length=9):
    """Boxes that drift, vanish and cross: (cx, cy, w, h, confidence, ratios)."""
    rng = random.Random(seed)
    out = {}
    for s in range(n):
        at = [rng.random() for _ in range(rng.randint(1, 3))]
        frames = []
        for _ in range(length):
            at = [x + rng.uniform(-0.08, 0.12) for x in at]
            frames.append([(x, 0.5, rng.uniform(0.15, 0.4), rng.choice([0.2, 0.3, 0.5]), round(rng.random(), 2), [r if (r := rng.random()) > 0.05 else None for _ in THRESHOLDS]) for x in at if rng.random() < 0.75])
        out[s] = frames
    return out


def plain(data, grid):
    """Of each setting: tp, fp, fn, tn, mean_ttd, median_ttd."""
    names, runs, rows = list(grid), {}, {}
    for values in product(*grid.values()):
        p = dict(zip(names, values))
        late, counts = [], {"tp": 0, "fp": 0, "fn": 0, "tn": 0}
        for s, frames in data.items():
            key = (s, *[(k, v) for k, v in p.items() if k not in sweep.AFTER])
            if key not in runs:
                def keep(b):
                    changed = "min_ratio" not in p or ((r := b[5][THRESHOLDS.index(p["pixel_threshold"])]) is not None and r >= p["min_ratio"])  # noqa: B023
                    return b[4] >= p["confidence"] and (p["max_area"] is None or b[2] * b[3] <= p["max_area"]) and changed  # noqa: B023

                linker, tracks = sweep.Linker(p["iou"], p["max_misses"]), {}
                for at, frame in enumerate(frames):
                    boxes = [b for b in frame if keep(b)]
                    for t, j, streak, _ in linker.step([b[:4] for b in boxes])["hits"]:
                        tracks.setdefault(t, []).append((at, boxes[j], streak))
                runs[key] = tracks
            alarms = []
            for hits in runs[key].values():
                first, last = hits[0][1], hits[-1][1]
                sure = p["min_mean_confidence"] is None or sum(b[4] for _, b, _ in hits) / len(hits) >= p["min_mean_confidence"]
                grown = p["min_area_change"] is None or last[2] * last[3] / (first[2] * first[3]) >= p["min_area_change"]
                if sure and grown:
                    alarms += [at for at, _, streak in hits if streak >= p["min_consecutive"]]
            counts[("t" if bool(alarms) == (s % 2 == 0) else "f") + ("p" if alarms else "n")] += 1
            if alarms and s % 2 == 0:
                late.append(min(alarms))
        rows[values] = (*counts.values(), mean(late) if late else None, median(late) if late else None)
    return rows


def tables(spark, data):
    truth = spark.createDataFrame([(s, s % 2 == 0) for s in data], "sequence_id long, is_positive_gt boolean")
    slots = spark.createDataFrame([(s, f) for s, frames in data.items() for f in range(len(frames))], "sequence_id long, frame_idx int")
    boxes = [(s, f, j, *b) for s, frames in data.items() for f, frame in enumerate(frames) for j, b in enumerate(frame)]
    return truth, slots, spark.createDataFrame(boxes, "sequence_id long, frame_idx int, det_idx int, cx double, cy double, w double, h double, confidence double, r array<double>")


def held(rows, grid):
    return {tuple(r[c] for c in grid): (r.tp, r.fp, r.fn, r.tn, r.mean_ttd, r.median_ttd) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_tracker_grid(spark, seed):
    data = sequences(seed)
    truth, slots, boxes = tables(spark, data)
    frames = slots.join(boxes.drop("r"), ["sequence_id", "frame_idx"], "left")
    rows = sweep.tracker_sweep(frames, truth, GRID).collect()
    want = plain(data, GRID)
    assert len(rows) == len(want) == 17_280
    got = held(rows, GRID)
    assert {k: v[:4] for k, v in got.items()} == {k: v[:4] for k, v in want.items()}
    assert all(got[k][4:] == pytest.approx(v[4:]) if v[4] is not None else got[k][4:] == (None, None) for k, v in want.items())


def test_change_grid(spark):
    data = sequences(3)
    truth, slots, boxes = tables(spark, data)
    ratios = boxes.selectExpr("*", "posexplode(r) as (i, change_ratio)").selectExpr("* except (r, i)", f"array{tuple(THRESHOLDS)}[i] as pixel_threshold")
    rows = sweep.change_sweep(ratios, slots, truth, CHANGES).collect()
    want = plain(data, CHANGES)
    assert len(rows) == len(want)
    assert {k: v[:4] for k, v in held(rows, CHANGES).items()} == {k: v[:4] for k, v in want.items()}


def test_a_class_is_run_once(spark):
    """Every setting is in one class, and a class that bridged nothing and overlapped well holds many."""
    limits = [(i, iou, misses) for i, (iou, misses) in enumerate(product(GRID["iou"], GRID["max_misses"]))]
    still = [(at, [(0.5, 0.5, 0.2, 0.2)], [0.9]) for at in range(5)]
    found = sweep.classes(limits, lambda iou, misses: sweep._run(still, iou, misses, 3))
    assert len(found) == 1 and sorted(found[0][0]) == [s[0] for s in limits]
    gap = [(at, [(0.5, 0.5, 0.2, 0.2)] if at != 2 else [], [0.9] if at != 2 else []) for at in range(5)]
    found = sweep.classes(limits, lambda iou, misses: sweep._run(gap, iou, misses, 3))
    assert len(found) == 2 and sorted(s for same, _ in found for s in same) == [s[0] for s in limits]
    assert sweep.classes(limits, lambda iou, misses: sweep._run([], iou, misses, 3))[0][1] == {}


def test_long_sequences_are_read_through(tmp_path, monkeypatch):
    """A run holds live tracks only, and a sequence beyond HELD bytes is read from a file in blocks that cut frames."""
    limits = {"min_mean_confidence": [0.4], "min_area_change": [1.1]}

    def peak(n):
        tracemalloc.start()
        # no box overlaps the one before, so every frame ends a track
        best, _, _ = sweep._run(((at, [(at % 2, 0.5, 0.2, 0.2)], [at % 10 / 10]) for at in range(n)), 0.1, 0, 2, limits)
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert {k: v[0] for k, v in best.items()} == {(0, 0): 0, (1, 0): 4}
        return held

    assert peak(8000) < 2 * peak(800)
    monkeypatch.setattr(sweep, "HELD", 1000)
    monkeypatch.setattr(sweep, "TOGETHER", 7)
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    frames = [(at, [(j / 10, 0.5, 0.2, 0.3) for j in range(at % 4)], [at / 100] * (at % 4)) for at in range(60)]
    rows = sweep._Sequence()
    for at, boxes, sure in frames:
        held = [(at, True, (*b, s), at / 60) for b, s in zip(boxes, sure)] or [(at, False, [None] * 5, None)]
        rows.add(np.array(held, sweep.ROW))
    assert rows.file._rolled
    assert list(rows.frames(lambda some: some["is_box"])) == frames
    assert list(rows.frames(lambda some: some["is_box"] & (some["ratio"] >= 0.5))) == [(at, *(([], []) if at < 30 else x)) for at, *x in frames]
    rows.close()


def all_at_once(frames, grid, lanes):
    """Of each matching setting and combination of later parameters: the frame of the first alarm, from one pass; frames as (frame_idx, boxes with confidence)."""
    tracks, out = sweep._Tracks(lanes, sweep._After(grid)), {}
    for at, boxes in frames:
        tracks.step(at, [(*b, kept) for b in boxes if (kept := lanes.of_box(b[2] * b[3], b[4], float("nan")))])
    for later, at, some in tracks.alarms():
        for n in range(lanes.n):
            if some >> n & 1:
                assert (n, later) not in out
                out[n, later] = at
    return out


def one_by_one(frames, grid, lanes):
    """The same from a run of the linker for each setting."""
    limits, out = {c: sorted(v for v in grid[c] if v is not None) for c in sweep.AFTER[1:]}, {}
    for n, (confidence, max_area, iou, misses) in enumerate(lanes.settings):
        kept = [(at, [b for b in boxes if b[4] >= confidence and (max_area is None or b[2] * b[3] <= max_area)]) for at, boxes in frames]
        best, _, _ = sweep._run(((at, [b[:4] for b in boxes], [b[4] for b in boxes]) for at, boxes in kept), iou, misses, max(grid["min_consecutive"]), limits)
        for later, (streak, *least) in enumerate(product(*[grid[c] for c in sweep.AFTER])):
            passed = [held[streak - 1] for ranks, held in best.items() if all(v is None or limits[c].index(v) < rank for c, v, rank in zip(sweep.AFTER[1:], least, ranks))]
            if passed and min(passed) != sweep.NEVER:
                out[n, later] = min(passed)
    return out


@pytest.mark.parametrize("ends", [3, 20_000])
def test_all_settings_in_one_pass(monkeypatch, ends):
    """Boxes on a coarse grid, so overlaps tie, some without a confidence or a width: one pass for all settings gives what a run for each gives, and compares a pair of boxes once."""
    monkeypatch.setattr(sweep, "ENDS", ends)
    plain_iou, compared = sweep.box_iou, []
    monkeypatch.setattr(sweep, "box_iou", lambda a, b: compared.append((a, b)) or plain_iou(a, b))
    lanes, rng = sweep._Lanes(sweep.WHOLE), random.Random(5)
    for _ in range(12):
        some = lambda v: float("nan") if rng.random() < 0.03 else v
        frames = [(3 * at, [(rng.randrange(5) / 10, rng.randrange(3) / 10, some(rng.choice([0.2, 0.3])), rng.choice([0.2, 0.3, 0.6]), some(rng.randrange(1, 9) / 10)) for _ in range(rng.randrange(5))]) for at in range(14)]
        compared.clear()
        got = all_at_once(frames, sweep.WHOLE, lanes)
        sizes = [len(boxes) for _, boxes in frames]
        assert len(compared) <= sum(sizes[i] * sum(sizes[max(0, i - 3) : i]) for i in range(len(sizes)))
        assert got == one_by_one(frames, sweep.WHOLE, lanes)


def test_ends_that_decide_nothing_are_dropped(monkeypatch):
    """What a long sequence leaves behind doesn't grow with its length."""
    monkeypatch.setattr(sweep, "ENDS", 50)
    tracks = sweep._Tracks(sweep._Lanes(sweep.WHOLE), sweep._After(sweep.WHOLE))
    for at in range(4000):
        # no box overlaps the one before, so every frame ends a track
        tracks.step(at, [(at % 4, 0.5, 0.2, 0.2, 0.1 + at % 9 / 10, tracks.lanes.of_box(0.04, 0.1 + at % 9 / 10, 0.0))])
        assert len(tracks.ends) < 500 and len(tracks.live) < 5
    assert {at for _, at, _ in tracks.alarms()} <= set(range(9))


def test_counts_of_all_settings():
    """Digits of counts, and lists added up over partitions."""
    counts, want, rng = sweep._Counts(11), np.zeros(11, int), random.Random(1)
    for _ in range(300):
        some = rng.getrandbits(11) & ~4
        counts.add((1, 2, True, 7), some)
        want += [some >> n & 1 for n in range(11)]
    (batch,) = counts.batches()
    assert batch.column(4).to_pylist() == [want.tolist()] and not counts.digits
    rows = next(sweep._summed(11)(iter([batch, batch]))).to_pylist()
    assert [(r["setting"] - 11, r["n"]) for r in rows] == [(n, 2 * want[n]) for n in range(11) if n != 2]
    assert all((r["later"], r["is_positive_gt"], r["trigger_frame_index"]) == (2, True, 7) for r in rows)
