"""Leaderboards, top-k configurations, review queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Metrics of which less is better.
ASCENDING = {"fpr", "mean_ttd", "median_ttd"}


def leaderboard(entries: DataFrame, metric: str, name: str = "model_name") -> DataFrame:
    """Rank by a metric in its own direction, nulls last, ties by name. One row a model."""
    order = F.asc_nulls_last(metric) if metric in ASCENDING else F.desc_nulls_last(metric)
    return entries.withColumn("rank", F.row_number().over(Window.orderBy(order, name)))


def top_configs(configs: DataFrame, k: int, *ties: str) -> DataFrame:
    return configs.orderBy(F.desc("f1"), *ties).limit(k)


def fp_queue(judged: DataFrame, min_confidence: float, key: str = "stem") -> DataFrame:
    """Samples with a false positive box of enough confidence, by the largest such confidence."""
    bad = judged.where((F.col("verdict") == "fp") & (F.col("confidence") >= min_confidence))
    return bad.groupBy(key).agg(F.max("confidence").alias("max_confidence"), F.count("*").alias("n_fp")).orderBy(F.desc("max_confidence"), key)


def fn_queue(judged: DataFrame, key: str = "stem") -> DataFrame:
    """Samples with a missed truth box, by the largest missed area."""
    return judged.where("verdict = 'fn'").groupBy(key).agg(F.max("area").alias("max_area"), F.count("*").alias("n_fn")).orderBy(F.desc("max_area"), key)


def error_gallery(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Wrong samples by descending probability, with a key that sorts like them."""
    predicted = (F.col("prob") > threshold).cast("int")
    wrong = scored.withColumn("predicted", predicted).where(F.col("predicted") != F.col("truth"))
    return wrong.withColumn("key", F.format_string("%.3f_%s_%s", F.col("prob"), F.when(F.col("predicted") == 1, "fp").otherwise("fn"), F.col("sample_id").cast("string"))).orderBy(F.desc("prob"), "sample_id")
