"""Tube decisions: literal cases of every field, and a plain version of the fold on random tubes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqlens.operators import decisions

FRAMES = "sequence_id long, frame_idx int, det_idx int, class_id int, cx double, cy double, w double, h double, confidence double"
ENTRY = "struct<frame_idx: int, is_gap: boolean, class_id: int, cx: double, cy: double, w: double, h: double, confidence: double>"
TUBES = f"sequence_id long, tube_id int, start_frame int, end_frame int, entries array<{ENTRY}>, is_kept boolean, scores map<int, double>"


def frames_of(spark, sequences):
    """{id: [boxes' x by frame]}; all boxes 0.2 wide with confidence 0.5."""
    rows = []
    for s, frames in sequences.items():
        for at, xs in enumerate(frames):
            rows += [(s, at, j, 0, x, 0.5, 0.2, 0.2, 0.5) for j, x in enumerate(xs)] or [(s, at, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, FRAMES)


def scored(found, logit):
    return found.withColumn("scores", F.map_from_entries(F.transform(F.sequence(F.lit(1), F.size("entries")), lambda p: F.struct(p, logit(p)))))


def test_all_fields(spark):
    frames = frames_of(spark, {1: [[0.3], [0.3], [], [0.3], [0.3, 0.8]], 2: [[]], 3: [[0.3]] * 5})
    ready = decisions.preprocessing(frames, 4, 6, "symmetric", spark.range(1, 5).withColumnRenamed("id", "sequence_id"))
    found = decisions.candidate_tubes(frames, 4, 6, "symmetric")
    rows = {r.sequence_id: r for r in decisions.decide(ready, scored(found, lambda p: F.col("sequence_id") - 3 + p * 0.5), "max_logit", 1.0, [1.0, 0, 0, 0], 0.0).collect()}
    one = rows[1]
    assert one.details.preprocessing.asDict() == {"num_frames_input": 5, "num_truncated": 1, "padded_frame_indices": [0, 5]}
    assert one.details.tubes.num_candidates == 1
    (kept,) = one.details.tubes.kept
    assert (kept.tube_id, kept.start_frame, kept.end_frame, kept.logit) == (0, 0, 5, 1.0)
    assert kept.probability == pytest.approx(1 / (1 + math.exp(-1.0)))
    assert [(e.frame_idx, e.is_gap, e.confidence) for e in kept.entries] == [(0, False, 0.5), (1, False, 0.5), (2, False, 0.5), (3, True, 0.0), (4, False, 0.5), (5, False, 0.5)]
    assert kept.entries[3].bbox == pytest.approx([0.3, 0.5, 0.2, 0.2])
    assert (one.is_positive, one.trigger_frame_index, kept.first_crossing_frame, one.details.decision.trigger_tube_id) == (True, 5, 5, 0)
    assert (one.details.decision.aggregation, one.details.decision.threshold) == ("max_logit", 1.0)
    assert (rows[3].is_positive, rows[3].trigger_frame_index) == (True, 3)
    for empty, n in ((2, 1), (4, 0)):
        assert (rows[empty].is_positive, rows[empty].trigger_frame_index, rows[empty].details.tubes.kept, rows[empty].details.tubes.num_candidates) == (False, None, [], 0)
        assert rows[empty].details.preprocessing.num_frames_input == n
    assert rows[2].details.preprocessing.padded_frame_indices == [0, 1, 2, 4, 5] and rows[4].details.preprocessing.padded_frame_indices == []


def test_gaps_stay_empty_without_interpolation(spark):
    frames = frames_of(spark, {1: [[0.3], [0.3], [], [0.3]]})
    found = decisions.candidate_tubes(frames, interpolate=False)
    (kept,) = decisions.decide(decisions.preprocessing(frames), scored(found, lambda p: p * 1.0), coefficients=[0, 0, 1.0, 0]).head().details.tubes.kept
    assert (kept.entries[2].bbox, kept.entries[2].confidence, kept.entries[2].is_gap) == (None, None, True)
    assert kept.probability == pytest.approx(1 / (1 + math.exp(-0.5)))  # the mean is of observed entries


def test_missing_scores_and_unknown_choices(spark):
    frames = frames_of(spark, {1: [[0.3]] * 6})
    ready, found = decisions.preprocessing(frames), decisions.candidate_tubes(frames)
    table = lambda prefixes: spark.createDataFrame([(1, 0, p, 2.0) for p in prefixes], "sequence_id long, tube_id int, prefix int, logit double")
    run = lambda prefixes, t=0.0: decisions.decide(ready, decisions.with_scores(found, table(prefixes)), threshold=t).collect()
    assert run([4, 5, 6])[0].trigger_frame_index == 3
    assert run([6], 3.0)[0].is_positive is False  # only a qualifying tube needs its prefixes
    for lacking in ([4, 5], [4, 6]):
        with pytest.raises(Exception, match="score of"):
            run(lacking)
    with pytest.raises(ValueError):
        decisions.decide(ready, found, "mean")
    with pytest.raises(ValueError):
        decisions.decide(ready, found, "logistic")
    with pytest.raises(ValueError):
        decisions.preprocessing(frames, pad="left")


def test_fold_like_plain_version(spark):
    rng = random.Random(3)
    weights, intercept, least = [0.9, 0.8, 2.0, -0.1], -2.0, 3
    rows, want = [], {}
    for s in range(60):
        kept = []
        for t in range(rng.randint(0, 4)):
            start, n = rng.randint(0, 3), rng.randint(3, 9)
            confs = [rng.choice([None, rng.random()]) for _ in range(n)]
            logits = [rng.gauss(0, 2) for _ in range(n)]
            keep = rng.random() < 0.8
            rows.append((s, t, start, start + n - 1, [(start + i, c is None, 0, None, None, None, None, c) for i, c in enumerate(confs)], keep, {i + 1: v for i, v in enumerate(logits)}))
            if keep:
                kept.append((t, start, confs, logits))
        best = None
        for t, start, confs, logits in kept:
            def positive(p):
                seen = [c for c in confs[:p] if c is not None]
                features = [logits[p - 1], math.log1p(p), sum(seen) / len(seen) if seen else 0.0, len(kept)]
                return 1 / (1 + math.exp(-(intercept + sum(w * x for w, x in zip(weights, features))))) >= 0.5
            if positive(len(confs)):
                at = next(p for p in range(least, len(confs) + 1) if positive(p))
                best = min(best or (99, 99), (start + at - 1, t))
        want[s] = best
    ready = spark.range(60).select(F.col("id").alias("sequence_id"), F.lit(1).alias("preprocessing"))
    got = decisions.decide(ready, spark.createDataFrame(rows, TUBES), "logistic", 0.5, weights, intercept, least).collect()
    assert {r.sequence_id: (r.trigger_frame_index, r.details.decision.trigger_tube_id) if r.is_positive else None for r in got} == want
    assert sum(v is not None for v in want.values()) > 10
