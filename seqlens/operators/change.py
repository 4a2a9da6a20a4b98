"""Frame differences: rasters are row-major arrays of grey values with their height and width."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import corners
from .tracking import track


def change_mask(one, two, threshold: int = 19) -> Column:
    """Whether each pixel differs by more than the threshold."""
    return F.zip_with(one, two, lambda a, b: F.abs(a - b) > threshold)


def difference(one, two) -> Column:
    return F.zip_with(one, two, lambda a, b: F.abs(a - b))


def pixel_region(height, width, cx, cy, w, h) -> Column:
    """A box cut off to whole pixels and clamped, as a struct x0, y0, x1, y1 (ends exclusive)."""
    left, top, right, bottom = corners(cx, cy, w, h)
    x0, y0 = F.greatest(F.lit(0), (left * width).cast("int")), F.greatest(F.lit(0), (top * height).cast("int"))
    x1, y1 = F.least(width, (right * width).cast("int")), F.least(height, (bottom * height).cast("int"))
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def _shares(thresholds: list[int]):
    """Adds `ratios` to frames (diff, height, width, regions): for each region its share of pixels above each threshold, by one summed-area table a threshold and four look-ups a region; 0 for an empty region."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.select(["diff", "height", "width", "regions"]).to_pylist() if batch.num_rows else []:
                x0, y0, x1, y1 = np.array([[r[c] for c in ("x0", "y0", "x1", "y1")] for r in row["regions"]], np.int64).reshape(-1, 4).T
                n = np.maximum(x1 - x0, 0) * np.maximum(y1 - y0, 0)
                shares = np.zeros((len(n), len(thresholds)))
                diff, real = np.array(row["diff"]).reshape(row["height"], row["width"]), n > 0
                for t, threshold in enumerate(thresholds):
                    table = np.zeros((row["height"] + 1, row["width"] + 1), np.int64)
                    table[1:, 1:] = (diff > threshold).cumsum(0).cumsum(1)
                    a, b, c, d = x0[real], y0[real], x1[real], y1[real]
                    shares[real, t] = (table[d, c] - table[b, c] - table[d, a] + table[b, a]) / n[real]
                found.append(shares.tolist())
            kept = batch.drop_columns(["diff", "height", "width", "regions"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.list_(pa.list_(pa.float64())))], [*kept.schema.names, "ratios"])

    return task


def with_difference(frames: DataFrame) -> DataFrame:
    """frames (sequence_id, frame_idx, height, width, px) with diff to the frame before: null for the first frame, where either can't be read (null px) or where the size changed."""
    by = Window.partitionBy("sequence_id").orderBy("frame_idx")
    rows = frames.select("*", *[F.lag(c).over(by).alias(f"p_{c}") for c in ("height", "width", "px")])
    same = (F.col("height") == F.col("p_height")) & (F.col("width") == F.col("p_width")) & (F.size("px") == F.size("p_px"))
    return rows.withColumn("diff", F.when(same, difference("p_px", "px"))).drop("p_height", "p_width", "p_px")


def change_ratios(frames: DataFrame, detections: DataFrame, thresholds: list[int]) -> DataFrame:
    """Ratios of every detection at each pixel threshold, from one difference: the detection's columns, pixel_threshold, change_ratio. Detections of frames without a difference have null."""
    diffs = with_difference(frames).where("diff is not null").select("sequence_id", "frame_idx", "height", "width", "diff")
    each = F.struct(*[F.col(f"d.{c}").alias(c) for c in detections.columns])
    # the boxes of a frame travel with its difference
    seen = detections.alias("d").join(diffs.select("sequence_id", "frame_idx", F.lit(True).alias("has_diff"), "height", "width").alias("s"), ["sequence_id", "frame_idx"], "left")
    box = each.alias("detection"), F.when(F.col("has_diff"), pixel_region(F.col("height"), F.col("width"), "d.cx", "d.cy", "d.w", "d.h")).alias("region")
    seen = seen.select("sequence_id", "frame_idx", "has_diff", *box)
    nested = seen.where("has_diff").groupBy("sequence_id", "frame_idx").agg(F.collect_list(F.struct("detection", "region")).alias("boxes"))
    ready = nested.join(diffs, ["sequence_id", "frame_idx"]).select(F.col("boxes.detection").alias("detections"), F.col("boxes.region").alias("regions"), "diff", "height", "width")
    kind = ready.schema["detections"].dataType.simpleString()
    shares = ready.mapInArrow(_shares(thresholds), f"detections {kind}, ratios array<array<double>>").select(F.explode(F.arrays_zip("detections", "ratios")).alias("x"))
    unknown = seen.where("has_diff is null").select(F.struct(F.col("detection").alias("detections"), F.array(*[F.lit(None).cast("double")] * len(thresholds)).alias("ratios")).alias("x"))
    at = F.arrays_zip(F.array(*map(F.lit, thresholds)).alias("pixel_threshold"), F.col("x.ratios").alias("change_ratio"))
    rows = shares.unionByName(unknown).select("x.detections.*", F.explode(at).alias("y"))
    return rows.select(*detections.columns, F.col("y.pixel_threshold").alias("pixel_threshold"), F.col("y.change_ratio").alias("change_ratio"))


def validate(frames: DataFrame, detections: DataFrame, threshold: int = 19, min_ratio: float = 0.1) -> DataFrame:
    """Detections in whose box enough pixels changed, with change_ratio. Padded repeats of a frame have no change and so lose theirs."""
    return change_ratios(frames, detections, [threshold]).drop("pixel_threshold").where(F.col("change_ratio") >= min_ratio)


def validated_track(frames: DataFrame, detections: DataFrame, threshold: int, min_ratio: float, min_confidence: float, **tracker) -> tuple[DataFrame, DataFrame]:
    """(tracks over validated detections, detections before and after validation by sequence)."""
    confident = detections.where(F.col("confidence") >= min_confidence)
    kept = validate(frames, confident, threshold, min_ratio)
    slots = frames.select("sequence_id", "frame_idx")
    counted = slots.select("sequence_id").distinct().join(confident.groupBy("sequence_id").agg(F.count("*").alias("n_before")), "sequence_id", "left").join(kept.groupBy("sequence_id").agg(F.count("*").alias("n_after")), "sequence_id", "left").fillna(0)
    return track(slots.join(kept.drop("change_ratio"), ["sequence_id", "frame_idx"], "left"), **tracker), counted
