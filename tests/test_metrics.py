"""Metrics, curves, thresholds, tube scores, calibrator: literal cases."""

import functools
import math
import operator

import pytest
from pyspark.sql import functions as F

from seqlens.operators import metrics, models, ranking, tube_scores

SCORED = "variant string, truth int, prob double"


def test_ttd_mean_and_median(spark):
    rows = spark.createDataFrame([("m", True, True, 2), ("m", True, True, 6), ("m", False, True, 1), ("m", True, False, None)], "model_name string, is_positive_gt boolean, is_positive boolean, trigger_frame_index int")
    r = metrics.sequence_metrics(rows, ["model_name"]).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.mean_ttd, r.median_ttd) == (2, 1, 1, 0, 4.0, 4.0)
    assert math.isclose(r.precision, 2 / 3) and r.fpr == 1.0 and r.tp_pct == 66.67


def test_empty_metrics(spark):
    rows = spark.createDataFrame([], "model_name string, is_positive_gt boolean, is_positive boolean, trigger_frame_index int")
    r = metrics.sequence_metrics(rows, []).first()
    assert (r.tp, r.precision, r.recall, r.f1, r.fpr, r.mean_ttd) == (0, 0.0, 0.0, 0.0, 0.0, None)


def test_fp_at_recall(spark):
    rows = spark.createDataFrame([("v", t, p) for p, t in [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0), (0.5, 0)]], SCORED)
    got = {r.target: r.fp for r in metrics.fp_at_recall(rows, ["variant"], [1.0, 0.5]).collect()}
    assert got == {1.0: 1, 0.5: 0}
    none = spark.createDataFrame([("v", 0, 0.4)], SCORED)
    assert metrics.fp_at_recall(none, ["variant"], [0.9]).first().fp is None


def test_areas(spark):
    rows = spark.createDataFrame([("v", 1, 0.9), ("v", 0, 0.9), ("v", 1, 0.5), ("v", 0, 0.1), ("one", 1, 0.3), ("none", 0, 0.3), ("inf", 1, 0.5), ("inf", 0, float("-inf"))], SCORED)
    points = metrics.curve(rows, ["variant"])
    ap = {r.variant: r.pr_auc for r in metrics.average_precision(points, ["variant"]).collect()}
    roc = {r.variant: r.roc_auc for r in metrics.roc_auc(points, ["variant"]).collect()}
    assert math.isclose(ap["v"], 0.5 * 0.5 + 0.5 * 2 / 3) and ap["none"] == 0.0 and ap["inf"] == 1.0
    assert math.isclose(roc["v"], (0.5 + 1 + 0 + 1) / 4) and roc["one"] == 0.0 and roc["inf"] == 1.0


def test_threshold_for_recall(spark):
    rows = spark.createDataFrame([("v", 1, float(i)) for i in range(100)], SCORED)
    assert metrics.threshold_for_recall(rows, ["variant"], 0.9, "prob").first().threshold == 9.0
    bad = spark.createDataFrame([("v", 0, 0.5)], SCORED)
    with pytest.raises(Exception, match="no positives"):
        metrics.checked(metrics.threshold_for_recall(bad, ["variant"], 0.9, "prob"), bad, ["variant"]).collect()


def test_aggregation_rules(spark):
    tubes = spark.createDataFrame([(1, 0, 0, 3, 2.0), (1, 1, 0, 0, 1.0)], "sequence_id long, tube_id int, start_frame int, end_frame int, logit double")
    seqs = spark.createDataFrame([(1, "smoke"), (2, "fp")], "sequence_id long, label string")
    got = {(r.sequence_id, r.rule, r.k): r.score for r in tube_scores.sequence_scores(tubes, seqs, [("max", 1), ("top_k_mean", 2), ("top_k_mean", 3), ("length_weighted_mean", 1)]).collect()}
    assert got[1, "max", 1] == 2.0 and got[1, "top_k_mean", 2] == 1.5 and got[1, "top_k_mean", 3] == float("-inf")
    assert math.isclose(got[1, "length_weighted_mean", 1], 9 / 5) and got[2, "max", 1] == float("-inf")
    with pytest.raises(ValueError, match="unknown rule"):
        tube_scores.score("least")


def test_confidence_floor(spark):
    rows = spark.createDataFrame([(float(i % 50),) for i in range(250)], "confidence double")
    ordered = sorted(float(i % 50) for i in range(250))
    r = tube_scores.confidence_floor(rows).first()
    assert (r.n_detections, r.min, r.p01, r.median) == (250, 0.0, ordered[2], ordered[125])
    assert tube_scores.confidence_floor(rows.limit(0)).first().n_detections == 0


def test_leaderboard_nulls_last(spark):
    rows = spark.createDataFrame([("b", 0.5, None), ("a", 0.5, 3.0), ("c", None, 1.0)], "model_name string, f1 double, mean_ttd double")
    assert [r.model_name for r in ranking.leaderboard(rows, "f1").orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r.model_name for r in ranking.leaderboard(rows, "mean_ttd").orderBy("rank").collect()] == ["c", "a", "b"]


def test_calibrator_fit_is_the_penalised_optimum(spark):
    rows = [(float(i % 7) - 3, (i % 5) / 2.0, (i % 3) / 3.0, float(i % 4), int((i * 7) % 10 > 4 - (i % 7) / 2)) for i in range(80)]
    features = spark.createDataFrame(rows, "logit double, log_len double, mean_conf double, n_tubes double, truth int")
    w, b = models.fit_calibrator(features)
    # at the optimum of sum(log loss) + |w|^2 / 2 the gradient is zero
    p = [1 / (1 + math.exp(-(sum(a * x for a, x in zip(w, r)) + b))) for r in rows]
    for j in range(4):
        assert abs(sum((p[i] - rows[i][4]) * rows[i][j] for i in range(80)) + w[j]) < 1e-2
    assert abs(sum(p[i] - rows[i][4] for i in range(80))) < 1e-2
    checks = models.sanity_rows(features, w, b)
    models.verify(checks, w, b)
    with pytest.raises(ValueError, match="sanity"):
        models.verify(checks, w, b + 0.1)
    with pytest.raises(ValueError, match="both classes"):
        models.fit_calibrator(features.where("truth = 1"))


def test_equal_tubes_have_equal_means(spark):
    """However their entries are dealt, so the sanity rows are of the distinct tubes' probabilities."""
    conf = [0.1, 0.7, 0.3, 1e16, 0.2, -1e16, 0.9, 0.6]
    rows = [(t, 0, f, c) for t in range(40) for f, c in sorted(enumerate(conf), key=lambda x: (x[0] * (t + 3)) % 11)]
    entries = spark.createDataFrame([*rows, (99, 0, 0, None)], "sequence_id long, tube_id int, frame_idx int, confidence double").repartition(7, "confidence")
    found = {r.sequence_id: (r.length, r.mean_conf, r.max_conf) for r in tube_scores.statistics(entries).collect()}
    assert found.pop(99) == (1, 0.0, 0.0)
    assert set(found.values()) == {(8, functools.reduce(operator.add, conf) / 8, 1e16)}
    features = spark.createDataFrame([(float(i), 0.0, 0.0, 0.0) for i in range(7)], "logit double, log_len double, mean_conf double, n_tubes double")
    assert sorted(r.logit for r in models.sanity_rows(features, [0.1, 0.0, 0.0, 0.0], 0.0).collect()) == [0.0, 3.0, 6.0]


def test_registry():
    with pytest.raises(KeyError, match="unknown model"):
        models.REGISTRY.load("nobody")


def test_ttd_histogram(spark):
    rows = spark.createDataFrame([("m", True, True, i) for i in (0, 1, 20, 20)], "model_name string, is_positive_gt boolean, is_positive boolean, trigger_frame_index int")
    got = {r.bin: r.n for r in metrics.ttd_histogram(rows, ["model_name"]).collect()}
    assert got == {0: 1, 1: 1, 19: 2}
    one = rows.where("trigger_frame_index = 1")
    assert [(r.bin, r.low, r.n) for r in metrics.ttd_histogram(one, ["model_name"]).select("bin", F.round("low", 3).alias("low"), "n").collect()] == [(10, 1.0, 1)]
