"""From scored tubes to decisions: aggregation rules, simulations, calibrator features.

Tubes are rows (sequence_id, tube_id, start_frame, end_frame, n_observed, logit and, where needed, mean_conf and max_conf); sequences are rows with sequence_id and label (smoke or fp)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import calibrated
from . import ranks
from .metrics import counts, metrics_at, threshold_for_recall, with_rates

NONE = float("-inf")
FEATURES = ("logit", "log_len", "mean_conf", "n_tubes")
RULES = ("max", "top_k_mean", "mean", "length_weighted_mean")


def _length() -> Column:
    return F.col("end_frame") - F.col("start_frame") + 1


def statistics(entries: DataFrame) -> DataFrame:
    """length, mean_conf and max_conf of each tube. Interpolated entries count with their confidence 0, null ones don't. Confidences are added in the order of frames, so equal tubes have equal means to the last bit."""
    known = F.array_sort(F.collect_list(F.when(F.col("confidence").isNotNull(), F.struct("frame_idx", F.col("confidence").cast("double").alias("c")))))
    found = entries.groupBy("sequence_id", "tube_id").agg((F.max("frame_idx") - F.min("frame_idx") + 1).alias("length"), known.alias("known"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("max_conf"))
    mean = F.when(F.size("known") > 0, F.aggregate("known", F.lit(0.0), lambda a, x: a + x["c"]) / F.size("known")).otherwise(0.0)
    return found.select("sequence_id", "tube_id", "length", mean.alias("mean_conf"), "max_conf")


def score(rule: str, k: int = 1) -> Column:
    """Aggregate of a sequence's tubes, -inf for none or (top_k_mean) fewer than k."""
    if rule == "max":
        return F.coalesce(F.max("logit"), F.lit(NONE))
    if rule == "mean":
        return F.coalesce(F.avg("logit"), F.lit(NONE))
    if rule == "length_weighted_mean":
        return F.coalesce(F.try_divide(F.sum(F.col("logit") * _length()), F.sum(_length()).cast("double")), F.lit(NONE))
    if rule == "top_k_mean":
        top = F.slice(F.sort_array(F.collect_list("logit"), asc=False), 1, k)
        return F.when(F.count("logit") >= k, F.aggregate(top, F.lit(0.0), lambda a, b: a + b) / k).otherwise(NONE)
    raise ValueError(f"unknown rule {rule!r}; one of {RULES}")


def sequence_scores(tubes: DataFrame, sequences: DataFrame, rules: list[tuple[str, int]]) -> DataFrame:
    """Scores of each sequence under each (rule, k): sequence_id, its columns, rule, k, score. One aggregation for all rules."""
    named = [score(r, k).alias(f"s{i}") for i, (r, k) in enumerate(rules)]
    found = sequences.join(tubes.groupBy("sequence_id").agg(*named), "sequence_id", "left")
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(k).alias("k"), F.coalesce(F.col(f"s{i}"), F.lit(NONE)).alias("score")) for i, (r, k) in enumerate(rules)])
    return found.select(*sequences.columns, F.explode(rows).alias("x")).select(*sequences.columns, "x.*")


def rule_summary(scores: DataFrame, target: float, by: list[str]) -> DataFrame:
    """Threshold for the target recall of each rule, and metrics there."""
    keys = [*by, "rule", "k"]
    scored = scores.withColumn("truth", (F.col("label") == "smoke").cast("int"))
    return metrics_at(scored, threshold_for_recall(scored, keys, target), keys)


def _decided(decisions: DataFrame, by: list[str]) -> DataFrame:
    return with_rates(decisions.groupBy(*by).agg(*counts(F.col("label") == "smoke", F.col("positive"))))


def confidence_filter(tubes: DataFrame, sequences: DataFrame, taus: list[float], threshold: float) -> DataFrame:
    """For each tau and label: n_total, n_no_tubes, n_all_drop and counts, if tubes with max_conf below tau were dropped."""
    best = [F.max(F.when(F.col("max_conf") >= t, F.col("logit"))).alias(f"m{i}") for i, t in enumerate(taus)]
    joined = sequences.join(tubes.groupBy("sequence_id").agg(F.count("*").alias("n_tubes"), *best), "sequence_id", "left")
    rows = F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"m{i}").alias("best")) for i, t in enumerate(taus)])
    each = joined.select("label", "n_tubes", F.explode(rows).alias("x")).select("label", "n_tubes", "x.*")
    positive = F.coalesce(F.col("best") >= threshold, F.lit(False))
    has = F.col("n_tubes").isNotNull()
    return each.groupBy("tau", "label").agg(F.count("*").alias("n_total"), F.count_if(~has).alias("n_no_tubes"), F.count_if(has & F.col("best").isNull()).alias("n_all_drop"), *counts(F.col("label") == "smoke", positive))


def tube_selection(tubes: DataFrame, sequences: DataFrame, n: int | None, threshold: float) -> DataFrame:
    """Metrics if only the n longest tubes of a sequence (ties by id) counted; all of them for None."""
    if n is not None:
        longest = Window.partitionBy("sequence_id").orderBy(F.desc(_length()), "tube_id")
        tubes = tubes.withColumn("nth", F.row_number().over(longest)).where(F.col("nth") <= n)
    best = tubes.groupBy("sequence_id").agg(F.max("logit").alias("best"))
    decided = sequences.join(best, "sequence_id", "left").withColumn("positive", F.coalesce(F.col("best") >= threshold, F.lit(False)))
    return _decided(decided, []).withColumn("n", F.lit(n).cast("int"))


def confidence_floor(detections: DataFrame, confidence: str = "confidence") -> DataFrame:
    """n, min, p01 (place n // 100) and median (place n // 2) of the sorted confidences."""
    found = ranks.values_at(detections, [], confidence, {"min": lambda n: F.lit(0), "p01": lambda n: F.floor(n / 100), "median": lambda n: F.floor(n / 2)})
    return found.select(F.col("n").alias("n_detections"), "min", "p01", "median")


def calibrator_features(tubes: DataFrame, sequences: DataFrame) -> DataFrame:
    """logit, log_len, mean_conf and n_tubes of each sequence's best tube (ties by id), zeros without tubes."""
    best = F.max_by(F.struct("logit", _length().alias("length"), "mean_conf"), F.struct("logit", -F.col("tube_id"))).alias("b")
    joined = sequences.join(tubes.groupBy("sequence_id").agg(best, F.count("*").alias("n")), "sequence_id", "left")
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return joined.select(*sequences.columns, zero(F.col("b.logit")).alias("logit"), zero(F.log1p("b.length")).alias("log_len"), zero(F.col("b.mean_conf")).alias("mean_conf"), zero(F.col("n")).alias("n_tubes"))


def calibrator_metrics(features: DataFrame, coefficients: list[float], intercept: float, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """Counts and rates of the calibrated probability at each threshold."""
    probability = features.withColumn("prob", calibrated(FEATURES, coefficients, intercept))
    each = probability.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("positive", F.col("prob") >= F.col("threshold"))
    return _decided(each, [*(by or []), "threshold"])


def drop_summary(judged: DataFrame) -> DataFrame:
    """Sequences by label and drop reason (kept for none)."""
    return judged.groupBy("label", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
