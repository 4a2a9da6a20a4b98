"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar


def detection_passes(min_confidence: float, max_area: float | None = None, max_width: float | None = None, prefix: str = "") -> Column:
    """Whether a detection is confident enough and not too large."""
    ok = F.col(f"{prefix}confidence") >= min_confidence
    if max_area is not None:
        ok = ok & (F.col(f"{prefix}w") * F.col(f"{prefix}h") <= max_area)
    if max_width is not None:
        ok = ok & (F.col(f"{prefix}w") <= max_width)
    return ok


def filter_detections(detections: DataFrame, min_confidence: float, max_area: float | None = None, max_width: float | None = None) -> DataFrame:
    """Long form: the detections that pass; frames are kept by joining back to the frame table."""
    return detections.where(detection_passes(min_confidence, max_area, max_width))


def filter_frames(frames: DataFrame, min_confidence: float, max_area: float | None = None) -> DataFrame:
    """Nested form (detections: array): each frame stays, with the detections that pass."""
    passes = lambda d: (d["confidence"] >= min_confidence) & (F.lit(True) if max_area is None else d["w"] * d["h"] <= max_area)
    return frames.withColumn("detections", F.filter("detections", passes))


def with_prefix(df: DataFrame, prefix: str, column: str = "sequence_id") -> DataFrame:
    """Rows whose id begins with a prefix; reaches the scan as a pushed filter."""
    return df.where(F.col(column).startswith(prefix))


def long_tubes(tubes: DataFrame, min_length: int, min_observed: int) -> DataFrame:
    """Tubes of enough frames, of which enough are observed."""
    return tubes.where((F.col("end_frame") - F.col("start_frame") + 1 >= min_length) & (F.col("n_observed") >= min_observed))


def drop_reason(has_labels, n_frames, n_detections, n_tubes, length, n_observed, min_length: int, min_observed: int) -> Column:
    """First failing rule, null for a sequence that is kept."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (
        F.when(~c(has_labels), "no_labels_dir")
        .when(c(n_frames) == 0, "no_frames")
        .when(c(n_detections) < min_observed, "no_detections")
        .when(F.coalesce(c(n_tubes), F.lit(0)) == 0, "no_tubes")
        .when(c(length) < min_length, "too_short")
        .when(c(n_observed) < min_observed, "too_few_observed")
    )


def operating_points(configs: DataFrame, min_precision: float, min_recall: float) -> DataFrame:
    return configs.where((F.col("precision") >= min_precision) & (F.col("recall") >= min_recall))


def first_errors(predictions: DataFrame, most: int, by: list[Column | str], truth: str = "is_positive_gt", predicted: str = "is_positive") -> DataFrame:
    """Wrong predictions only, the first `most` of each kind."""
    wrong = predictions.withColumn("kind", scalar.error_kind(truth, predicted)).where("kind is not null")
    return wrong.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy(*by))).where(F.col("nth") <= most)
