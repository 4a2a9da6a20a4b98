"""Sliding-window confidence smoothing over a camera's last frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry


def smoothed_windows(detections: DataFrame, windows: list[int]) -> DataFrame:
    """For each window the confidence of each frame with detections: the largest, over its boxes, of the sum of confidences of all boxes in the last `window` frames that overlap it (itself included), over window + 1. One join at the widest window serves all.

    Confidences are added from the newest frame back, in the order of boxes, so a threshold that a sum hits exactly is decided alike in every run."""
    keep = ["sequence_id", "frame_idx", "det_idx", "cx", "cy", "w", "h", "confidence"]
    now = detections.select(*keep[:-1])
    # every detection reaches the frames it is in the window of, so the join has an equal key
    past = detections.select("sequence_id", F.posexplode(F.sequence("frame_idx", F.col("frame_idx") + max(windows) - 1)).alias("back", "frame_idx"), *[F.col(c).alias(f"p_{c}") for c in keep[2:]])
    over = now.join(past, ["sequence_id", "frame_idx"]).where(geometry.iou(geometry.box(), geometry.box("p_")) > 0)
    # windows begin at the newest frame, so their sums are those of the sorted list's first places
    seen = F.array_sort(F.collect_list(F.struct("back", "p_det_idx", F.col("p_confidence").cast("double").alias("c"))))
    within = lambda n: (F.aggregate(F.filter("seen", lambda x: x["back"] < n), F.lit(0.0), lambda a, x: a + x["c"]) / (n + 1)).alias(f"s{n}")
    sums = over.groupBy("sequence_id", "frame_idx", "det_idx").agg(seen.alias("seen")).select("sequence_id", "frame_idx", "det_idx", *map(within, windows))
    best = sums.groupBy("sequence_id", "frame_idx").agg(*[F.max(f"s{n}").alias(f"s{n}") for n in windows])
    each = F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"s{n}").alias("smoothed")) for n in windows])
    return best.select("sequence_id", "frame_idx", F.explode(each).alias("x")).select("sequence_id", "frame_idx", "x.*")


def smoothed(detections: DataFrame, window: int) -> DataFrame:
    """The same for one window: sequence_id, frame_idx, smoothed."""
    return smoothed_windows(detections, [window]).drop("window")


def smoothed_alarms(detections: DataFrame, sequences: DataFrame, window: int, threshold: float) -> DataFrame:
    """Of every sequence: is_positive and the first frame whose smoothed confidence is above the threshold."""
    first = smoothed(detections, window).where(F.col("smoothed") > threshold).groupBy("sequence_id").agg(F.min("frame_idx").alias("trigger_frame_index"))
    return sequences.join(first, "sequence_id", "left").withColumn("is_positive", F.col("trigger_frame_index").isNotNull())
