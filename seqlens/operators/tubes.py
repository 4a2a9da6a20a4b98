"""Tubes: boxes linked over time with gaps, their interpolation, selection and first crossing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import BOX
from .filters import drop_reason
from .tracking import linked

KEYS = ["sequence_id", "tube_id"]


def build(frames: DataFrame, min_iou: float = 0.2, max_misses: int = 2) -> DataFrame:
    """Entries of all tubes, gaps included: sequence_id, tube_id, frame_idx, det_idx and box (null in gaps), is_gap. Ids are in order of birth; a tube ends at its last hit."""
    found = linked(frames, min_iou, max_misses, gaps=True).withColumnRenamed("track_id", "tube_id")
    return found.select(*KEYS, "frame_idx", "det_idx", "class_id", *BOX, "confidence", F.col("det_idx").isNull().alias("is_gap"))


def interpolate(entries: DataFrame) -> DataFrame:
    """Boxes for gap entries: between the boxes before and behind in proportion to the entries passed, or the only one there is. Confidence 0, class of the box before."""
    by = Window.partitionBy(*KEYS).orderBy("frame_idx")
    before, behind = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    rows = entries.withColumn("i", F.row_number().over(by))
    mark = F.when(~F.col("is_gap"), F.struct("i", "class_id", *BOX))
    rows = rows.withColumn("was", F.last(mark, ignorenulls=True).over(before)).withColumn("next", F.first(mark, ignorenulls=True).over(behind))
    part = (F.col("i") - F.col("was.i")) / (F.col("next.i") - F.col("was.i"))
    between = lambda c: F.coalesce(F.col(f"was.{c}") + part * (F.col(f"next.{c}") - F.col(f"was.{c}")), F.col(f"was.{c}"), F.col(f"next.{c}"))
    filled = {c: F.when(F.col("is_gap"), between(c)).otherwise(F.col(c)) for c in BOX}
    rows = rows.withColumns(filled | {"class_id": F.when(F.col("is_gap"), F.coalesce("was.class_id", "next.class_id")).otherwise(F.col("class_id")), "confidence": F.when(F.col("is_gap"), 0.0).otherwise(F.col("confidence"))})
    return rows.drop("i", "was", "next")


def summary(entries: DataFrame) -> DataFrame:
    """start_frame, end_frame and n_observed of each tube."""
    return entries.groupBy(*KEYS).agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count_if(~F.col("is_gap")).cast("int").alias("n_observed"))


def longest(tubes: DataFrame) -> DataFrame:
    """One tube of each sequence: the longest span, then the most observed entries, then the first."""
    best = Window.partitionBy("sequence_id").orderBy(F.desc(F.col("end_frame") - F.col("start_frame")), F.desc("n_observed"), "tube_id")
    return tubes.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def tube_dataset(frames: DataFrame, min_iou: float = 0.2, max_misses: int = 2, min_length: int = 4, min_observed: int = 2) -> tuple[DataFrame, DataFrame]:
    """(entries of the longest tube of each kept sequence, interpolated; sequences with their drop reason, null if kept). frames: long form, with a has_labels column if folders may lack labels."""
    labels = F.bool_or("has_labels") if "has_labels" in frames.columns else F.lit(True)
    stats = frames.groupBy("sequence_id").agg(F.count_distinct("frame_idx").alias("n_frames"), F.count("det_idx").alias("n_detections"), labels.alias("has_labels"))
    entries = build(frames, min_iou, max_misses)
    tubes = summary(entries)
    chosen = longest(tubes).withColumn("length", F.col("end_frame") - F.col("start_frame") + 1)
    counted = tubes.groupBy("sequence_id").agg(F.count("*").alias("n_tubes"))
    judged = stats.join(counted, "sequence_id", "left").join(chosen, "sequence_id", "left")
    judged = judged.withColumn("reason", drop_reason("has_labels", "n_frames", "n_detections", "n_tubes", "length", "n_observed", min_length, min_observed))
    kept = judged.where("reason is null").select("sequence_id", "tube_id")
    return interpolate(entries.join(kept, KEYS, "left_semi")), judged.select("sequence_id", "n_frames", "n_detections", "n_tubes", "tube_id", "length", "n_observed", "reason")


def records(entries: DataFrame) -> DataFrame:
    """Tubes in nested form: start_frame, end_frame and entries in order."""
    entry = F.struct("frame_idx", "is_gap", "class_id", *BOX, "confidence")
    return entries.groupBy(*KEYS).agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.array_sort(F.collect_list(entry)).alias("entries"))


def entries_of(tube_records: DataFrame) -> DataFrame:
    """Long form of nested tubes."""
    return tube_records.select(*KEYS, F.explode("entries").alias("e")).select(*KEYS, "e.*")


def first_crossing(prefixes: DataFrame, min_prefix: int, decides) -> tuple[DataFrame, DataFrame]:
    """(crossing of each qualifying tube, trigger of each sequence).

    prefixes: sequence_id, tube_id, prefix (entries), frame_idx (of its last), and whatever `decides` (a boolean column) needs. A tube qualifies if its full length is decided positive; it crosses at the shortest prefix of at least min_prefix that is. Of a sequence's tubes the earliest frame counts, then the smallest id."""
    rows = prefixes.withColumn("positive", decides)
    full = rows.groupBy(*KEYS).agg(F.max_by("positive", "prefix").alias("qualifies"))
    crossed = rows.where((F.col("prefix") >= min_prefix) & F.col("positive")).join(full.where("qualifies"), KEYS, "left_semi")
    crossed = crossed.groupBy(*KEYS).agg(F.min(F.struct("prefix", "frame_idx")).alias("x")).select(*KEYS, F.col("x.frame_idx").alias("crossing_frame"), F.col("x.prefix").alias("prefix_length"))
    first = crossed.groupBy("sequence_id").agg(F.min(F.struct("crossing_frame", "tube_id")).alias("t"))
    triggers = first.select("sequence_id", F.col("t.crossing_frame").alias("trigger_frame_index"), F.col("t.tube_id").alias("trigger_tube_id"))
    return crossed, triggers

