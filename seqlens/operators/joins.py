"""Joins of frames, boxes, truth and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.scalar import rate


def attach_truth(predictions: DataFrame, truth: DataFrame, default: bool = False) -> DataFrame:
    """Every prediction, with is_positive_gt; a sequence without truth has the default."""
    return predictions.join(truth, "sequence_id", "left").withColumn("is_positive_gt", F.coalesce("is_positive_gt", F.lit(default)))


def attach_known_truth(predictions: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions with truth, sequences skipped for lack of it)."""
    return predictions.join(truth, "sequence_id"), predictions.join(truth, "sequence_id", "left_anti").select("sequence_id").distinct()


def consecutive_pairs(detections: DataFrame, min_iou: float) -> DataFrame:
    """Detections of consecutive frames that overlap by min_iou: sequence_id, frame_idx (of the later), prev_idx, det_idx, iou."""
    keep = ["sequence_id", "frame_idx", "det_idx", "cx", "cy", "w", "h"]
    now = detections.select(*keep)
    before = detections.select("sequence_id", (F.col("frame_idx") + 1).alias("frame_idx"), *[F.col(c).alias(f"p_{c}") for c in ("det_idx", "cx", "cy", "w", "h")])
    paired = now.join(before, ["sequence_id", "frame_idx"]).withColumn("iou", geometry.iou(geometry.box("p_"), geometry.box()))
    return paired.where(F.col("iou") >= min_iou).select("sequence_id", "frame_idx", F.col("p_det_idx").alias("prev_idx"), "det_idx", "iou")


def greedy(pairs: Column, order: list[Column] | None = None) -> Column:
    """One-to-one matches of an array of (iou, i, j): best overlap first, ties by (i, j)."""
    best_first = F.array_sort(F.transform(pairs, lambda p: F.struct((-p["iou"]).alias("minus"), p["i"].alias("i"), p["j"].alias("j"))))
    none = F.filter(best_first, lambda p: F.lit(False))
    free = lambda held, p: ~F.exists(held, lambda q: (q["i"] == p["i"]) | (q["j"] == p["j"]))
    return F.aggregate(best_first, none, lambda held, p: F.when(free(held, p), F.concat(held, F.array(p))).otherwise(held))


def greedy_matches(pairs: DataFrame, keys: list[str], i: str = "prev_idx", j: str = "det_idx") -> DataFrame:
    """Greedy one-to-one matching within each group of keys, from pairs with an iou. Groups are frame pairs and so are small."""
    grouped = pairs.groupBy(*keys).agg(F.collect_list(F.struct(F.col("iou"), F.col(i).alias("i"), F.col(j).alias("j"))).alias("pairs"))
    return grouped.select(*keys, F.explode(greedy(F.col("pairs"))).alias("m")).select(*keys, F.col("m.i").alias(i), F.col("m.j").alias(j), (-F.col("m.minus")).alias("iou"))


def evaluate_boxes(predicted: DataFrame, truth: DataFrame, min_iou: float, key: str = "stem") -> DataFrame:
    """Per-box verdicts of a frame-level evaluation: predictions by descending confidence take the free truth box they overlap most.

    predicted: key, pred_idx, box, confidence; truth: key, gt_idx, box. Returns key, pred_idx, gt_idx, confidence, area (of the truth box for a miss), iou, verdict (tp, fp, fn)."""
    p = predicted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("minus"), F.col("pred_idx"), F.col("cx"), F.col("cy"), F.col("w"), F.col("h")))).alias("preds"))
    t = truth.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("gt_idx"), F.col("cx"), F.col("cy"), F.col("w"), F.col("h")))).alias("gts"))
    parts = lambda x: (x["cx"], x["cy"], x["w"], x["h"])
    none = F.array().cast("array<struct<pred_idx: int, gt_idx: int, iou: double>>")

    def take(held: Column, pred: Column) -> Column:
        free = F.filter(F.coalesce("gts", F.array().cast("array<struct<gt_idx: int, cx: double, cy: double, w: double, h: double>>")), lambda g: ~F.exists(held, lambda q: q["gt_idx"].eqNullSafe(g["gt_idx"])))
        scored = F.filter(F.transform(free, lambda g: F.struct(geometry.iou(parts(pred), parts(g)).alias("iou"), (-g["gt_idx"]).alias("minus_gt"))), lambda s: s["iou"] >= min_iou)
        best = F.array_max(scored)
        row = F.struct(pred["pred_idx"].cast("int").alias("pred_idx"), (-best["minus_gt"]).cast("int").alias("gt_idx"), best["iou"].cast("double").alias("iou"))
        return F.concat(held, F.array(row))

    both = p.join(t, key, "full").withColumn("matched", F.aggregate(F.coalesce("preds", F.array().cast("array<struct<minus: double, pred_idx: int, cx: double, cy: double, w: double, h: double>>")), none, take))
    both = both.select(key, F.explode_outer("matched").alias("m")).where("m is not null").select(key, "m.*")
    judged = predicted.select(key, F.col("pred_idx").cast("int").alias("pred_idx"), "confidence").join(both, [key, "pred_idx"])
    judged = judged.select(key, "pred_idx", "gt_idx", "confidence", F.lit(None).cast("double").alias("area"), "iou", F.when(F.col("gt_idx").isNull(), "fp").otherwise("tp").alias("verdict"))
    missed = truth.select(key, F.col("gt_idx").cast("int").alias("gt_idx"), (F.col("w") * F.col("h")).alias("area")).join(both.where("gt_idx is not null").select(key, "gt_idx"), [key, "gt_idx"], "left_anti")
    missed = missed.select(key, F.lit(None).cast("int").alias("pred_idx"), "gt_idx", F.lit(None).cast("double").alias("confidence"), "area", F.lit(None).cast("double").alias("iou"), F.lit("fn").alias("verdict"))
    return judged.unionByName(missed)


def sample_counts(verdicts: DataFrame, samples: DataFrame, key: str = "stem") -> DataFrame:
    """eval_tp, eval_fp and eval_fn of every sample, zeros without boxes."""
    found = verdicts.groupBy(key).agg(*[F.count_if(F.col("verdict") == v).alias(f"eval_{v}") for v in ("tp", "fp", "fn")])
    return samples.select(key).distinct().join(found, key, "left").fillna(0, ["eval_tp", "eval_fp", "eval_fn"])


def evaluation_summary(verdicts: DataFrame, samples: DataFrame, min_confidence: float, key: str = "stem") -> DataFrame:
    """One row: num_samples, tp, fp, fn, precision, recall, and how many samples the review queues hold: fp_review_samples (a false box of at least min_confidence) and fn_review_samples (a missed box)."""
    sure = (F.col("verdict") == "fp") & (F.col("confidence") >= min_confidence)
    queues = verdicts.groupBy(key).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("tp", "fp", "fn")], F.bool_or(sure).alias("in_fp"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    counted = queues.agg(total("tp"), total("fp"), total("fn"), F.count_if("in_fp").alias("fp_review_samples"), F.count_if(F.col("fn") > 0).alias("fn_review_samples"))
    n = samples.agg(F.count_distinct(key).alias("num_samples"))  # one row beside one row
    return n.crossJoin(counted).withColumns({"precision": rate("tp", F.col("tp") + F.col("fp")), "recall": rate("tp", F.col("tp") + F.col("fn"))})


def review_sets(refs: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(errors, missing): refs (sequence_id, is_positive_gt) whose prediction is wrong, with kind fp or fn; refs without a prediction."""
    joined = refs.join(predictions.select("sequence_id", "is_positive", "trigger_frame_index"), "sequence_id", "left")
    kind = F.when(~F.col("is_positive_gt") & F.col("is_positive"), "fp").when(F.col("is_positive_gt") & ~F.col("is_positive"), "fn")
    return joined.withColumn("kind", kind).where("kind is not null"), refs.join(predictions, "sequence_id", "left_anti")


def source_frame(wanted: DataFrame, frames: DataFrame) -> DataFrame:
    """wanted (sequence_id, frame_id) with the frame_idx of that id; an id that isn't there has the sequence's last frame."""
    at = frames.groupBy("sequence_id", "frame_id").agg(F.min("frame_idx").alias("found"))
    last = frames.groupBy("sequence_id").agg(F.max("frame_idx").alias("last"))
    return wanted.join(at, ["sequence_id", "frame_id"], "left").join(last, "sequence_id", "left").withColumn("frame_idx", F.coalesce("found", "last")).drop("found", "last")


def tube_timeline(tubes: DataFrame, entries: DataFrame) -> DataFrame:
    """One row for each tube and frame of its span, with the observed entry's columns or nulls, and cell det or gap."""
    cells = tubes.select("sequence_id", "tube_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame_idx"))
    joined = cells.join(entries.withColumn("seen", F.lit(True)), ["sequence_id", "tube_id", "frame_idx"], "left")
    return joined.withColumn("cell", F.when(F.col("seen"), "det").otherwise("gap")).drop("seen")


def review_frames(errors: DataFrame, frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Misclassified sequences as one row for each frame, with its boxes (array, by det_idx) and the sequence's attributes."""
    wrong = errors.select("sequence_id", "kind", "trigger_frame_index")
    boxes = detections.join(wrong.select("sequence_id").distinct(), "sequence_id", "left_semi").groupBy("sequence_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("det_idx", "cx", "cy", "w", "h", "confidence"))).alias("boxes"))
    none = F.array().cast("array<struct<det_idx: int, cx: double, cy: double, w: double, h: double, confidence: double>>")
    return frames.join(wrong, "sequence_id").join(boxes, ["sequence_id", "frame_idx"], "left").withColumn("boxes", F.coalesce("boxes", none)).withColumn("is_trigger", F.coalesce(F.col("frame_idx") == F.col("trigger_frame_index"), F.lit(False)))
