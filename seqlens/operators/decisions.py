"""Tube decisions: from frames and scored tubes to an alarm, the frame that raised it, and the details of both.

Frames are truncated and padded, linked into candidate tubes, filtered and interpolated; a kept tube comes with `scores`, the logit of each of its prefixes by the number of entries. One ordered fold over a tube's entries carries the running mean confidence, the length and the logit of the prefix, so every prefix is decided in one pass. A tube qualifies if its full length is decided positive; it crosses at its shortest positive prefix, and the earliest crossing of a sequence, then the smallest tube, is the trigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import calibrated
from . import shape, tubes
from .joins import attach_truth

PADDING = {"symmetric": shape.pad_symmetric, "uniform": shape.pad_uniform}
AGGREGATIONS = ("max_logit", "logistic")


def _padded(frames: DataFrame, max_frames: int, min_frames: int, pad: str) -> DataFrame:
    if pad not in PADDING:
        raise ValueError(f"unknown padding {pad!r}; one of {sorted(PADDING)}")
    slots = frames.select("sequence_id", "frame_idx").distinct()
    return PADDING[pad](shape.truncate(slots, max_frames), min_frames)


def preprocessing(frames: DataFrame, max_frames: int = 20, min_frames: int = 0, pad: str = "symmetric", sequences: DataFrame | None = None) -> DataFrame:
    """sequence_id and preprocessing (num_frames_input, num_truncated, padded_frame_indices). sequences: those without any frame get a row too."""
    n = F.count_distinct("frame_idx")
    counted = frames.groupBy("sequence_id").agg(n.cast("int").alias("num_frames_input"), F.greatest(n - max_frames, F.lit(0)).cast("int").alias("num_truncated"))
    marks = _padded(frames, max_frames, min_frames, pad).where("is_padded").groupBy("sequence_id").agg(F.array_sort(F.collect_list("slot")).alias("padded_frame_indices"))
    found = counted.join(marks, "sequence_id", "left")
    if sequences is not None:
        found = sequences.select("sequence_id").distinct().join(found, "sequence_id", "left").fillna(0, ["num_frames_input", "num_truncated"])
    indices = F.coalesce("padded_frame_indices", F.array().cast("array<int>")).alias("padded_frame_indices")
    return found.select("sequence_id", F.struct("num_frames_input", "num_truncated", indices).alias("preprocessing"))


def candidate_tubes(frames: DataFrame, max_frames: int = 20, min_frames: int = 0, pad: str = "symmetric", min_iou: float = 0.2, max_misses: int = 2, min_length: int = 4, min_observed: int = 2, interpolate: bool = True) -> DataFrame:
    """All tubes of the truncated and padded frames: sequence_id, tube_id, start_frame, end_frame, entries, is_kept (long enough and observed often enough). frame_idx counts padded slots. Without interpolation gaps have neither box nor confidence."""
    slots = _padded(frames, max_frames, min_frames, pad).select("sequence_id", F.col("slot").alias("__at"), "frame_idx")
    rows = slots.join(frames.where("det_idx is not null"), ["sequence_id", "frame_idx"], "left").drop("frame_idx").withColumnRenamed("__at", "frame_idx")
    entries = tubes.build(rows, min_iou, max_misses)
    found = tubes.records(tubes.interpolate(entries) if interpolate else entries)
    kept = (F.col("end_frame") - F.col("start_frame") + 1 >= min_length) & (F.size(F.filter("entries", lambda e: ~e["is_gap"])) >= min_observed)
    return found.withColumn("is_kept", kept)


def with_scores(candidates: DataFrame, prefix_logits: DataFrame) -> DataFrame:
    """Candidates with scores from a table (sequence_id, tube_id, prefix, logit), one row a prefix."""
    scores = prefix_logits.groupBy(*tubes.KEYS).agg(F.map_from_entries(F.collect_list(F.struct("prefix", "logit"))).alias("scores"))
    return candidates.join(scores, tubes.KEYS, "left")


def _fold(least: int, probability: Callable[[Column, Column, Column, Column], Column], decides: Callable[[Column, Column], Column]) -> Column:
    """The state after a tube's last entry: prefix, total and n of the confidences, logit, probability, positive (of the last prefix), crossing_frame, lacking (a prefix of at least `least` entries has no score)."""
    start = F.struct(F.lit(0).alias("prefix"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("logit"), F.lit(None).cast("double").alias("probability"), F.lit(False).alias("positive"), F.lit(None).cast("int").alias("crossing_frame"), F.lit(False).alias("lacking"))

    def step(was: Column, e: Column) -> Column:
        prefix = was["prefix"] + 1
        total = was["total"] + F.coalesce(e["confidence"], F.lit(0.0))
        n = was["n"] + e["confidence"].isNotNull().cast("int")
        logit = F.element_at("scores", prefix).cast("double")
        sure = probability(logit, F.log1p((e["frame_idx"] - F.col("start_frame") + 1).cast("double")), F.when(n > 0, total / n).otherwise(0.0), F.col("n_tubes").cast("double"))
        positive = F.coalesce(decides(logit, sure), F.lit(False))
        crossing = F.coalesce(was["crossing_frame"], F.when((prefix >= least) & positive, e["frame_idx"]))
        return F.struct(prefix.alias("prefix"), total.alias("total"), n.alias("n"), logit.alias("logit"), sure.alias("probability"), positive.alias("positive"), crossing.alias("crossing_frame"), (was["lacking"] | ((prefix >= least) & logit.isNull())).alias("lacking"))

    return F.aggregate("entries", start, step)


def decide(preprocessed: DataFrame, scored: DataFrame, aggregation: str = "max_logit", threshold: float = 0.0, coefficients: list[float] | None = None, intercept: float = 0.0, min_prefix: int = 4) -> DataFrame:
    """Of every preprocessed sequence: is_positive, trigger_frame_index and details (preprocessing, tubes, decision).

    scored: candidates with `scores`. max_logit compares the logit with the threshold, logistic the calibrated probability (coefficients of logit, log_len, mean_conf and n_tubes). A kept tube whose full length has no score is an error, and so is a qualifying one that lacks a prefix's."""
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {aggregation!r}; one of {AGGREGATIONS}")
    if aggregation == "logistic" and coefficients is None:
        raise ValueError("the logistic aggregation needs a fitted calibrator")
    probability = lambda *features: F.lit(None).cast("double") if coefficients is None else calibrated(list(features), coefficients, intercept)
    decides = (lambda logit, sure: logit >= threshold) if aggregation == "max_logit" else (lambda logit, sure: sure >= threshold)
    counted = scored.withColumn("n_tubes", F.count_if("is_kept").over(Window.partitionBy("sequence_id")))
    folded = counted.withColumn("last", F.when(F.col("is_kept"), _fold(min_prefix, probability, decides)))
    named = F.concat(F.lit("tube "), F.col("tube_id").cast("string"), F.lit(" of sequence "), F.col("sequence_id").cast("string"))
    complaint = F.when(F.col("last.logit").isNull(), F.concat(named, F.lit(" has no score of its full length"))).when(F.col("last.positive") & F.col("last.lacking"), F.concat(named, F.lit(" lacks the score of a prefix")))
    logit = F.when(F.col("is_kept"), F.coalesce(F.when(complaint.isNotNull(), F.raise_error(complaint).cast("double")), F.col("last.logit")))
    entry = lambda e: F.struct(e["frame_idx"].alias("frame_idx"), F.when(e["cx"].isNotNull(), F.array(e["cx"], e["cy"], e["w"], e["h"])).alias("bbox"), e["is_gap"].alias("is_gap"), e["confidence"].alias("confidence"))
    tube = F.struct("tube_id", "start_frame", "end_frame", logit.alias("logit"), F.col("last.probability").alias("probability"), F.when(F.col("last.positive"), F.col("last.crossing_frame")).alias("first_crossing_frame"), F.transform("entries", entry).alias("entries"))
    crossed = F.when(F.col("last.positive"), F.struct(F.col("last.crossing_frame").alias("frame"), "tube_id"))
    by_sequence = folded.groupBy("sequence_id").agg(F.count("*").cast("int").alias("num_candidates"), F.array_sort(F.collect_list(F.when(F.col("is_kept"), tube))).alias("kept"), F.min(crossed).alias("trigger"))
    found = preprocessed.join(by_sequence, "sequence_id", "left")
    nothing = F.array().cast(by_sequence.schema["kept"].dataType)
    inside = F.struct(F.coalesce("num_candidates", F.lit(0)).alias("num_candidates"), F.coalesce("kept", nothing).alias("kept"))
    decision = F.struct(F.lit(aggregation).alias("aggregation"), F.lit(float(threshold)).alias("threshold"), F.col("trigger.tube_id").alias("trigger_tube_id"))
    details = F.struct("preprocessing", inside.alias("tubes"), decision.alias("decision")).alias("details")
    return found.select("sequence_id", F.col("trigger").isNotNull().alias("is_positive"), F.col("trigger.frame").alias("trigger_frame_index"), details)


def pipeline_records(decided: DataFrame, truth: DataFrame) -> DataFrame:
    """Label (smoke or fp), decision and kept tubes of each decided sequence, for calibration."""
    label = F.when(F.col("is_positive_gt"), "smoke").otherwise("fp")
    return attach_truth(decided, truth).select("sequence_id", label.alias("label"), "is_positive", F.col("trigger_frame_index").alias("trigger"), F.col("details.tubes.kept").alias("kept_tubes"))


def record_features(records: DataFrame) -> DataFrame:
    """Calibrator features of each record's best tube by logit: sequence_id, label, logit, log_len, mean_conf, n_tubes; zeros without kept tubes."""
    known = F.col("best.entries.confidence")
    sure = F.filter(known, lambda c: c.isNotNull())
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.size(sure))
    best = F.get(F.array_sort(F.col("kept_tubes"), lambda a, b: F.when(a["logit"] > b["logit"], -1).when(a["logit"] < b["logit"], 1).otherwise(a["tube_id"] - b["tube_id"])), F.lit(0))
    rows = records.withColumn("best", best)
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return rows.select("sequence_id", "label", zero(F.col("best.logit")).alias("logit"), zero(F.log1p((F.col("best.end_frame") - F.col("best.start_frame") + 1).cast("double"))).alias("log_len"), zero(mean).alias("mean_conf"), F.size("kept_tubes").cast("double").alias("n_tubes"))
