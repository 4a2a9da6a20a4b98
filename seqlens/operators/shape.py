"""Sequence shaping: indexing, padding, truncation, slotting, augmentation, pooling."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry


def index_frames(frames: DataFrame, *order: str) -> DataFrame:
    """frame_idx from 0 in each sequence, by `order` (ts, then frame_id)."""
    by = Window.partitionBy("sequence_id").orderBy(*(order or ("ts", "frame_id")))
    return frames.withColumn("frame_idx", (F.row_number().over(by) - 1).cast("int"))


def _slots(frames: DataFrame, length: int, source) -> DataFrame:
    """The slots of each sequence, at least `length`: slot, and the frame_idx that source(slot, n) names."""
    counted = frames.groupBy("sequence_id").agg((F.max("frame_idx") + 1).alias("n"))
    total = F.greatest(F.col("n"), F.lit(length))
    slots = counted.select("sequence_id", "n", F.explode(F.sequence(F.lit(0), total - 1)).alias("slot"))
    return slots.withColumn("frame_idx", source(F.col("slot"), F.col("n")).cast("int"))


def pad_symmetric(frames: DataFrame, length: int) -> DataFrame:
    """At least `length` slots: the first frame before and the last behind, in turn, first the first. is_padded marks repeats."""
    before = lambda n: F.when(n < length, F.ceil((length - n) / 2)).otherwise(0)
    slots = _slots(frames, length, lambda s, n: F.greatest(F.lit(0), F.least(n - 1, s - before(n))))
    slots = slots.withColumn("is_padded", F.col("slot") - before(F.col("n")) != F.col("frame_idx"))
    return slots.drop("n").join(frames, ["sequence_id", "frame_idx"])


def pad_uniform(frames: DataFrame, length: int) -> DataFrame:
    """At least `length` slots, each frame repeated as evenly as can be; its first slot is the real one."""
    total = lambda n: F.greatest(n, F.lit(length))
    slots = _slots(frames, length, lambda s, n: F.floor(s * n / total(n)))
    first = F.row_number().over(Window.partitionBy("sequence_id", "frame_idx").orderBy("slot"))
    return slots.withColumn("is_padded", first > 1).drop("n").join(frames, ["sequence_id", "frame_idx"])


def truncate(frames: DataFrame, most: int) -> DataFrame:
    """The first `most` frames of each sequence."""
    return frames.where(F.col("frame_idx") < most)


def truncation_counts(frames: DataFrame, most: int) -> DataFrame:
    """sequence_id, n_kept, n_truncated."""
    n = F.count("*")
    return frames.groupBy("sequence_id").agg(F.least(n, F.lit(most)).cast("long").alias("n_kept"), F.greatest(n - most, F.lit(0)).cast("long").alias("n_truncated"))


def truncate_by_name(frames: DataFrame, most: int) -> DataFrame:
    """The first `most` frames of each sequence by frame_id, indexed."""
    return truncate(index_frames(frames, "frame_id"), most)


def model_input(entries: DataFrame, width: int, height: int, context: float = 1.5) -> DataFrame:
    """Crop window of each tube entry after context expansion: x0, y0, x1, y1 beside its keys and gap flag."""
    w, h = geometry.expand("w", "h", context)
    x0, y0, x1, y1 = geometry.pixel_square("cx", "cy", w, h, width, height)
    return entries.select("sequence_id", "tube_id", "frame_idx", "is_gap", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def model_input_index(manifest: DataFrame) -> DataFrame:
    """Entries and gaps of each tube of a manifest."""
    return manifest.groupBy("sequence_id", "tube_id").agg(F.count("*").alias("n_entries"), F.count_if("is_gap").alias("n_gaps"))


def slot_entries(entries: DataFrame, length: int) -> DataFrame:
    """Exactly `length` slots for each tube: its first entries, then empty ones; mask tells them apart."""
    nth = F.row_number().over(Window.partitionBy("sequence_id", "tube_id").orderBy("frame_idx")) - 1
    placed = entries.withColumn("slot", nth).where(F.col("slot") < length).select("sequence_id", "tube_id", "slot", "frame_idx")
    slots = entries.select("sequence_id", "tube_id").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return slots.join(placed, ["sequence_id", "tube_id", "slot"], "left").withColumn("mask", F.col("frame_idx").isNotNull())


def draw(*parts) -> Column:
    """A number from 0 (below 1) that the parts name: the first 32 bits of the md5 of their texts, joined by colons."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def augment(entries: DataFrame, seed: int, epoch: int = 0, p_sub: float = 0.5, p_stride: float = 0.3, p_drop: float = 0.1, min_sub: int = 4, min_kept: int = 4) -> DataFrame:
    """Temporal augmentation of tubes, the same for the same seed and epoch: a sub-sequence, every second entry, single entries dropped, then indexed anew.

    A sub-sequence of a tube with more than min_sub entries has from min_sub to all of them, each length alike. Every second entry is taken where more than two are left. Where more than min_kept are left each entry is dropped for itself, and if fewer than min_kept stay, dropped ones come back in an order of their own."""
    keys = ["sequence_id", "tube_id"]
    chance = lambda name, *more: draw(F.lit(seed), F.lit(epoch), F.lit(name), *keys, *more)
    by, whole = Window.partitionBy(*keys).orderBy("frame_idx"), Window.partitionBy(*keys)
    indexed = lambda df: df.withColumn("i", F.row_number().over(by) - 1).withColumn("n", F.count("*").over(whole))
    rows = indexed(entries)
    size = F.lit(min_sub) + F.floor(chance("size") * (F.col("n") - min_sub + 1))
    start = F.floor(chance("start") * (F.col("n") - size + 1))
    sub = (chance("sub") < p_sub) & (F.col("n") > min_sub)
    rows = indexed(rows.where(~sub | ((F.col("i") >= start) & (F.col("i") < start + size))))
    rows = rows.where(~((chance("stride") < p_stride) & (F.col("n") > 2)) | (F.col("i") % 2 == 0)).withColumn("n", F.count("*").over(whole))
    kept = (chance("drop", "frame_idx") >= p_drop) | (F.col("n") <= min_kept)
    rows = rows.withColumn("kept", kept).withColumn("n_kept", F.count_if("kept").over(whole))
    back = F.row_number().over(Window.partitionBy(*keys, "kept").orderBy(chance("restore", "frame_idx"), "frame_idx"))
    rows = rows.withColumn("back", back).where(F.col("kept") | (F.col("back") <= min_kept - F.col("n_kept")))
    return rows.withColumn("slot", (F.row_number().over(by) - 1).cast("int")).drop("i", "n", "kept", "n_kept", "back")


def mean_pool(vectors: DataFrame, keys: list[str], vector: str = "embedding", mask: str | None = None) -> DataFrame:
    """Mean of the vectors of each key, all of one length and without nulls, over rows where mask holds. Vectors are added up before they are shuffled."""
    rows = vectors if mask is None else vectors.where(F.col(mask))
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return rows.groupBy(*keys).agg(vector_to_array(mean).alias("pooled"))
