"""Queries: metrics, curves, thresholds, latency, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, metrics, ranking
from . import adapters as A
from .registry import query, rounded

RATES = "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr"
R6 = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr"


def counted(by: str, source: str, t: str, p: str, more: str = "") -> str:
    """SQL of counts by group."""
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"SELECT {keys}count(*) FILTER (({t}) AND ({p})) AS tp, count(*) FILTER (NOT ({t}) AND ({p})) AS fp, count(*) FILTER (({t}) AND NOT ({p})) AS fn, count(*) FILTER (NOT ({t}) AND NOT ({p})) AS tn{more} FROM {source}{group}"


TTD = "CASE WHEN is_positive_gt AND is_positive THEN trigger_frame_index END"


def metrics_sql(source: str) -> str:
    return f"SELECT *, {RATES} FROM ({counted('model_name', source, 'is_positive_gt', 'is_positive', f', avg({TTD}) AS mean_ttd, median({TTD}) AS median_ttd')})"


METRICS = metrics_sql("v_result")
PERCENT = "round_even(coalesce({} * 100e0 / nullif({}, 0), 0), 2) AS {}_pct"
#: The columns of sequence metrics as the twins return them.
RETURNED = f"model_name, tp, fp, fn, tn, {R6}, round(mean_ttd, 6) AS mean_ttd, round(median_ttd, 6) AS median_ttd, " + ", ".join(PERCENT.format(c, "tp + fn" if c in ("tp", "fn") else "fp + tn", c) for c in ("tp", "fn", "fp", "tn"))


@query(f"SELECT {RETURNED} FROM ({METRICS})")
def g1_sequence_metrics(spark, d):
    return rounded(metrics.sequence_metrics(A.results(spark, d), ["model_name"]))


@query(f"SELECT model_name, tp, fp, fn, tn, {R6} FROM (SELECT *, {RATES} FROM ({counted('model_name', 'v_result', 'is_positive_gt', 'num_detections_total > 0')}))")
def g2_any_detection(spark, d):
    return rounded(metrics.with_rates(metrics.any_detection(A.results(spark, d)).groupBy("model_name").agg(*metrics.counts("is_positive_gt", "is_positive"))))


@query("SELECT sequence_id, count(DISTINCT frame_idx) FILTER (confidence > 0) AS num_detections_total FROM v_det GROUP BY 1")
def g2_any_confident_frame(spark, d):
    return metrics.any_confident_frame(A.detections(spark, d))


_STAGE = counted("model_name", "{}", "is_positive_gt", "is_positive")


@query(f"SELECT split, stage, tp, fp, fn, tn, {R6} FROM (SELECT *, {RATES} FROM (SELECT model_name AS split, 'all' AS stage, tp, fp, fn, tn FROM ({_STAGE.format('v_result')}) UNION ALL SELECT model_name, 'subset', tp, fp, fn, tn FROM ({_STAGE.format('(SELECT * FROM v_result WHERE starts_with(CAST(sequence_id AS VARCHAR), $$1$$))')})))")
def g3_all_and_subset(spark, d):
    rows = A.results(spark, d).withColumnRenamed("model_name", "split")
    return rounded(metrics.metrics_all_and_subset(rows, "split", "1"))


@query("SELECT model_name, truth, predicted, n, round(n / sum(n) OVER (PARTITION BY model_name, truth), 6) AS share FROM (SELECT model_name, is_positive_gt AS truth, is_positive AS predicted, count(*) AS n FROM v_result GROUP BY 1, 2, 3)")
def g4_confusion(spark, d):
    return rounded(metrics.confusion(A.results(spark, d), ["model_name"]))


@query(f"SELECT variant, tp, fp, fn, tn, tp + fp + fn + tn AS n, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM ({counted('variant', 'v_scored', 'truth = 1', 'prob > 0.5e0')})")
def g5_classifier_metrics(spark, d):
    return rounded(metrics.classifier_metrics(A.scored(spark, d), ["variant"]))


CURVE = "SELECT variant, prob AS score, pos_here, neg_here, sum(pos_here) OVER w AS tp, sum(neg_here) OVER w AS fp, sum(pos_here) OVER (PARTITION BY variant) AS pos, sum(neg_here) OVER (PARTITION BY variant) AS neg FROM (SELECT variant, prob, count(*) FILTER (truth = 1) AS pos_here, count(*) FILTER (truth = 0) AS neg_here FROM v_scored GROUP BY 1, 2) WINDOW w AS (PARTITION BY variant ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"SELECT variant, round(coalesce(sum(pos_here / nullif(pos, 0) * tp / (tp + fp)), 0), 6) AS pr_auc FROM ({CURVE}) GROUP BY 1")
def g6_pr_auc(spark, d):
    return rounded(metrics.average_precision(metrics.curve(A.scored(spark, d), ["variant"]), ["variant"]))


@query("SELECT v.variant, round(coalesce(sum(CASE WHEN p.prob > n.prob THEN 1e0 WHEN p.prob = n.prob THEN 0.5e0 WHEN p.prob < n.prob THEN 0e0 END) / nullif(count(p.prob + n.prob), 0), 0), 6) AS roc_auc FROM (SELECT DISTINCT variant FROM v_scored) v LEFT JOIN (SELECT * FROM v_scored WHERE truth = 1) p USING (variant) LEFT JOIN (SELECT * FROM v_scored WHERE truth = 0) n USING (variant) GROUP BY 1")
def g7_roc_auc(spark, d):
    return rounded(metrics.roc_auc(metrics.curve(A.scored(spark, d), ["variant"]), ["variant"]))


@query(f"SELECT variant, round(score, 6) AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / (tp + fp), 6) AS precision, round(coalesce(tp / nullif(pos, 0), 0), 6) AS tpr, round(coalesce(fp / nullif(neg, 0), 0), 6) AS fpr FROM ({CURVE})")
def g8_curve_points(spark, d):
    return rounded(metrics.curve_points(metrics.curve(A.scored(spark, d), ["variant"])).select("variant", "score", "tp", "fp", "precision", "tpr", "fpr"))


@query(f"SELECT variant, target, CAST(arg_max(fp - neg_here, score) FILTER (tp / pos >= target) AS BIGINT) AS fp FROM ({CURVE}), (SELECT unnest([0.9e0, 0.95e0, 0.97e0, 0.99e0]) AS target) GROUP BY 1, 2")
def g9_fp_at_recall(spark, d):
    return metrics.fp_at_recall(A.scored(spark, d), ["variant"], [0.9, 0.95, 0.97, 0.99])


THRESHOLD = "SELECT variant, list_sort(list(prob))[CAST(floor(count(*) * (1e0 - 0.9e0)) AS INT) + 1] AS threshold FROM v_scored WHERE truth = 1 GROUP BY 1"


@query(f"SELECT variant, round(threshold, 6) AS threshold FROM ({THRESHOLD})")
def g10_threshold_for_recall(spark, d):
    rows = A.scored(spark, d)
    return rounded(metrics.checked(metrics.threshold_for_recall(rows, ["variant"], 0.9, "prob"), rows, ["variant"]))


@query(f"SELECT variant, round(threshold, 6) AS threshold, tp, fp, fn, tn, {R6} FROM (SELECT *, {RATES} FROM ({counted('variant, threshold', f'v_scored JOIN ({THRESHOLD}) USING (variant)', 'truth = 1', 'prob >= threshold')}))")
def g11_metrics_at_threshold(spark, d):
    rows = A.scored(spark, d)
    return rounded(metrics.metrics_at(rows, metrics.threshold_for_recall(rows, ["variant"], 0.9, "prob"), ["variant"], "prob"))


CANDIDATES = "SELECT DISTINCT variant, round_even(prob, 4) AS threshold FROM v_scored WHERE truth = 1 UNION SELECT DISTINCT variant, unnest([-1.5e0, -0.5e0, 0.5e0, 1.5e0]) FROM v_scored"


@query(f"SELECT variant, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, abs(threshold - 0.5e0) < 1e-3 AS is_baked FROM (SELECT *, {RATES} FROM ({counted('variant, threshold', f'v_scored JOIN ({CANDIDATES}) USING (variant)', 'truth = 1', 'prob >= threshold')})) WHERE precision >= 0.85e0 AND recall >= 0.2e0")
def g12_threshold_sweep(spark, d):
    return rounded(metrics.threshold_sweep(A.scored(spark, d), ["variant"], 0.5, 0.85, 0.2, "prob"))


@query("SELECT event_type AS stage, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS n FROM v_event WHERE event_id >= 3 GROUP BY 1")
def g22_latency(spark, d):
    return rounded(metrics.stage_summary(A.events(spark, d).where("event_id >= 3").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))))


@query("SELECT stage, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(avg(ms), 6) AS mean, round(min(ms), 6) AS min, round(max(ms), 6) AS max, count(ms) AS n FROM (SELECT unnest(['total', 'a', 'other', 'per_frame']) AS stage, unnest([value, value * 0.6e0, value - value * 0.6e0, value / (k + 1)]) AS ms FROM (SELECT * FROM v_event ORDER BY event_id OFFSET 3)) GROUP BY 1")
def g22_latency_parts(spark, d):
    runs = A.events(spark, d).select("event_id", "value", (F.col("value") * 0.6).alias("a"), (F.col("k") + 1).alias("frames"))
    return rounded(metrics.latency_summary(runs, "value", ["a"], 3, "event_id", "frames"))


def training_log(spark, d):
    rows = A.table(spark, d, "orders")
    return rows.select(F.month("o_orderdate").alias("epoch"), F.col("o_orderkey").alias("step"), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice").cast("double")).alias("train_loss"), F.when(F.col("o_orderkey") % 50 == 0, (F.col("o_orderkey") % 997) / 997.0).alias("val_f1"))


@query("SELECT month(o_orderdate) AS epoch, round(avg(CAST(o_totalprice AS DOUBLE)), 2) AS train_loss FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def g23_train_loss(spark, d):
    return rounded(metrics.training_curves(training_log(spark, d))[0], 2)


@query("WITH v AS (SELECT month(o_orderdate) AS epoch, arg_max((o_orderkey % 997) / 997e0, o_orderkey) AS val_f1 FROM orders WHERE o_orderkey % 50 = 0 GROUP BY 1) SELECT epoch, round(val_f1, 6) AS val_f1, epoch = (SELECT epoch FROM v ORDER BY val_f1 DESC, epoch LIMIT 1) AS is_best FROM v")
def g23_validation(spark, d):
    return rounded(metrics.training_curves(training_log(spark, d))[1])


HIST = f"SELECT r.model_name, CAST(least(19, floor((r.ttd - low) / wide * 20)) AS INT) AS bin, low, wide, mean_ttd FROM (SELECT model_name, CAST({TTD} AS DOUBLE) AS ttd FROM v_result) r JOIN (SELECT model_name, avg({TTD}) AS mean_ttd, CAST(min({TTD}) AS DOUBLE) AS low, CAST(max({TTD}) - min({TTD}) AS DOUBLE) AS wide FROM v_result GROUP BY 1) USING (model_name) WHERE r.ttd IS NOT NULL"


@query(f"SELECT model_name, bin, round(low + bin * wide / 20, 6) AS low, round(low + (bin + 1) * wide / 20, 6) AS high, round(mean_ttd, 6) AS mean_ttd, count(*) AS n FROM ({HIST}) GROUP BY 1, 2, 3, 4, 5")
def g24_ttd_histogram(spark, d):
    return rounded(metrics.ttd_histogram(A.results(spark, d), ["model_name"]))


VARIANT = f"""SELECT f.variant, round(f1, 6) AS f1, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, fp_at_90, fp_at_95, fp_at_97, fp_at_99 FROM (SELECT variant, coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM ({counted('variant', 'v_scored', 'truth = 1', 'prob > 0.5e0')})) f
JOIN (SELECT variant, coalesce(sum(pos_here / nullif(pos, 0) * tp / (tp + fp)), 0) AS pr_auc, coalesce(sum(neg_here * (tp - pos_here / 2) / nullif(pos * neg, 0)), 0) AS roc_auc, {', '.join(f'CAST(arg_max(fp - neg_here, score) FILTER (tp / pos >= {t / 100}e0) AS BIGINT) AS fp_at_{t}' for t in (90, 95, 97, 99))} FROM ({CURVE}) GROUP BY 1) c USING (variant)"""


@query(VARIANT)
def g26_variant_comparison(spark, d):
    return rounded(metrics.variant_comparison(A.scored(spark, d)))


@query(f"SELECT round(max(f1) - min(f1), 5) AS f1_spread, round(max(pr_auc) - min(pr_auc), 5) AS pr_auc_spread, round(max(roc_auc) - min(roc_auc), 5) AS roc_auc_spread, {', '.join(f'max(fp_at_{t}) - min(fp_at_{t}) AS fp_at_{t}_spread' for t in (90, 95, 97, 99))} FROM ({VARIANT}) WHERE variant IN ('en', 'fr')")
def g26_noise_floor(spark, d):
    return rounded(metrics.noise_floor(metrics.variant_comparison(A.scored(spark, d)), ["en", "fr"]), 5)


@query(f"SELECT model_name, round(f1, 6) AS f1, CAST(row_number() OVER (ORDER BY f1 DESC NULLS LAST, model_name) AS INT) AS rank FROM ({METRICS})")
def j1_leaderboard(spark, d):
    found = metrics.sequence_metrics(A.results(spark, d), ["model_name"])
    return rounded(ranking.leaderboard(found, "f1").select("model_name", "f1", "rank"))


@query(f"SELECT model_name, round(mean_ttd, 6) AS mean_ttd, CAST(row_number() OVER (ORDER BY mean_ttd ASC NULLS LAST, model_name) AS INT) AS rank FROM ({METRICS})")
def j1_leaderboard_ttd(spark, d):
    found = metrics.sequence_metrics(A.results(spark, d), ["model_name"])
    return rounded(ranking.leaderboard(found, "mean_ttd").select("model_name", "mean_ttd", "rank"))


SWEEP = f"SELECT *, {RATES} FROM ({counted('variant, threshold', f'v_scored JOIN ({CANDIDATES}) USING (variant)', 'truth = 1', 'prob >= threshold')})"


@query(f"SELECT variant, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM ({SWEEP}) ORDER BY f1 DESC, variant, threshold LIMIT 10")
def j2_top_configs(spark, d):
    swept = metrics.threshold_sweep(A.scored(spark, d), ["variant"], 0.5, 0.0, 0.0, "prob")
    return rounded(ranking.top_configs(swept, 10, "variant", "threshold").select("variant", "threshold", "f1"))


@query(f"SELECT variant, round(threshold, 6) AS threshold FROM ({SWEEP}) WHERE precision >= 0.86e0 AND recall >= 0.5e0")
def c5_operating_points(spark, d):
    swept = metrics.threshold_sweep(A.scored(spark, d), ["variant"], 0.5, 0.0, 0.0, "prob")
    return rounded(filters.operating_points(swept, 0.86, 0.5).select("variant", "threshold"))


@query("SELECT variant, sample_id, CAST(prob > 0.5e0 AS INT) AS predicted, printf('%.3f_%s_%s', prob, CASE WHEN prob > 0.5e0 THEN 'fp' ELSE 'fn' END, CAST(sample_id AS VARCHAR)) AS key FROM v_scored WHERE (prob > 0.5e0) <> (truth = 1)")
def j5_error_gallery(spark, d):
    return ranking.error_gallery(A.scored(spark, d)).select("variant", "sample_id", "predicted", "key")


@query(f"SELECT 'a' AS split, model_name, tp FROM ({METRICS}) UNION ALL SELECT 'b', model_name, tp FROM ({counted('model_name', 'v_result', 'is_positive_gt', 'num_detections_total > 0')})")
def k8_union_of_results(spark, d):
    rows = A.results(spark, d)
    found = metrics.union_results({"a": metrics.sequence_metrics(rows, ["model_name"]), "b": metrics.sequence_metrics(metrics.any_detection(rows), ["model_name"])})
    return found.select("split", "model_name", "tp")
