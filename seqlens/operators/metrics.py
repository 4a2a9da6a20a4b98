"""Sequence metrics, curves, thresholds, latency and training summaries.

Curves come from one pass: rows are first counted by distinct score, then running sums go over the scores, inside a group (model, variant)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import f1, percent, rate, ttd
from . import ranks


def counts(truth, predicted) -> list[Column]:
    t, p = (F.col(x) if isinstance(x, str) else x for x in (truth, predicted))
    return [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")]


def with_rates(counted: DataFrame) -> DataFrame:
    """precision, recall, f1 and fpr beside tp, fp, fn, tn; 0 on an empty denominator."""
    found = counted.withColumn("precision", rate("tp", F.col("tp") + F.col("fp"))).withColumn("recall", rate("tp", F.col("tp") + F.col("fn")))
    return found.withColumn("f1", f1("precision", "recall")).withColumn("fpr", rate("fp", F.col("fp") + F.col("tn")))


def sequence_metrics(results: DataFrame, by: list[str], truth: str = "is_positive_gt", predicted: str = "is_positive", trigger: str = "trigger_frame_index") -> DataFrame:
    """Counts, row percentages, rates, mean and (interpolated) median frames to detection of each group."""
    late = ttd(truth, predicted, trigger)
    found = with_rates(results.groupBy(*by).agg(*counts(truth, predicted), F.avg(late).alias("mean_ttd"), F.median(late).alias("median_ttd")))
    real, other = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return found.withColumns({"tp_pct": percent("tp", real), "fn_pct": percent("fn", real), "fp_pct": percent("fp", other), "tn_pct": percent("tn", other)})


def any_detection(results: DataFrame, n_detections: str = "num_detections_total") -> DataFrame:
    """The naive baseline: positive at frame 0 if there is any detection."""
    return results.withColumn("is_positive", F.col(n_detections) > 0).withColumn("trigger_frame_index", F.when(F.col("is_positive"), 0))


def any_confident_frame(frames: DataFrame) -> DataFrame:
    """The sliding window's baseline from detections: frames with confidence above 0, positive if there is one."""
    n = F.count_distinct(F.when(F.col("confidence") > 0, F.col("frame_idx")))
    return frames.groupBy("sequence_id").agg(n.alias("num_detections_total"))


def metrics_all_and_subset(results: DataFrame, split: str, prefix: str) -> DataFrame:
    """Counts and rates of each split over all sequences and over those whose id has a prefix: one pass with grouping sets."""
    marked = results.withColumn("in_subset", F.col("sequence_id").cast("string").startswith(prefix))
    found = with_rates(marked.groupingSets([[split], [split, "in_subset"]], split, "in_subset").agg(F.grouping("in_subset").alias("g"), *counts("is_positive_gt", "is_positive")))
    return found.where("g = 1 or in_subset").withColumn("stage", F.when(F.col("g") == 1, "all").otherwise("subset")).drop("g", "in_subset")


def confusion(results: DataFrame, by: list[str], truth: str = "is_positive_gt", predicted: str = "is_positive") -> DataFrame:
    """Cells of the confusion matrix: n and share of its true class."""
    cells = results.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return cells.withColumn("share", rate("n", F.sum("n").over(Window.partitionBy(*by, "truth"))))


def classifier_metrics(scored: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Per-sample metrics with prob strictly above the threshold; denominators are 1 at least."""
    found = scored.groupBy(*by).agg(*counts(F.col("truth") == 1, F.col("prob") > threshold), F.count("*").alias("n"))
    at_least = lambda a, b: F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1))
    found = found.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.greatest(F.col("n"), F.lit(1))).withColumn("precision", at_least("tp", "fp")).withColumn("recall", at_least("tp", "fn"))
    return found.withColumn("f1", f1("precision", "recall"))


def curve(scored: DataFrame, by: list[str], score: str = "prob", truth: str = "truth") -> DataFrame:
    """One row for each distinct score of a group, from the highest: tp and fp at or above it, pos and neg of the group, pos_here and neg_here at it."""
    at = scored.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(truth) == 1).alias("pos_here"), F.count_if(F.col(truth) == 0).alias("neg_here"))
    found = ranks.running(at, by, "score", {"tp": F.col("pos_here"), "fp": F.col("neg_here")}, descending=True)
    return found.withColumnsRenamed({"tp_all": "pos", "fp_all": "neg"})


def average_precision(points: DataFrame, by: list[str]) -> DataFrame:
    """Stepwise average precision of a curve, tied scores together; 0 without positives."""
    step = F.col("pos_here") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return points.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("pos") > 0, step)), F.lit(0.0)).alias("pr_auc"))


def roc_auc(points: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve, ties half; 0 for a single class."""
    step = F.col("neg_here") * (F.col("tp") - F.col("pos_here") / 2) / (F.col("pos") * F.col("neg"))
    return points.groupBy(*by).agg(F.coalesce(F.sum(F.when((F.col("pos") > 0) & (F.col("neg") > 0), step)), F.lit(0.0)).alias("roc_auc"))


def curve_points(points: DataFrame) -> DataFrame:
    """precision, tpr (recall) and fpr at each score."""
    return points.withColumns({"precision": rate("tp", F.col("tp") + F.col("fp")), "tpr": rate("tp", "pos"), "fpr": rate("fp", "neg")})


def fp_at_recall(scored: DataFrame, by: list[str], targets: list[float], score: str = "prob", truth: str = "truth") -> DataFrame:
    """False positives above the point where each target recall is first reached, positives first among ties; null where it never is."""
    points = curve(scored, by, score, truth)
    goals = F.explode(F.array(*map(F.lit, targets))).alias("target")
    before = F.col("fp") - F.col("neg_here")
    reached = points.select(*by, goals, "score", "tp", before.alias("fp_before"), "pos").where((F.col("pos") > 0) & (F.col("tp") / F.col("pos") >= F.col("target")))
    best = reached.groupBy(*by, "target").agg(F.max_by("fp_before", "score").alias("fp"))
    return scored.select(*by).distinct().withColumn("target", F.explode(F.array(*map(F.lit, targets)))).join(best, [*by, "target"], "left")


def threshold_for_recall(scored: DataFrame, by: list[str], target: float, score: str = "score", truth: str = "truth") -> DataFrame:
    """The positive score at place floor(n * (1 - target)) from the lowest. A group without positives is an error, raised where `checked` is used."""
    if not 0 < target <= 1:
        raise ValueError(f"a target recall lies above 0 and up to 1, not at {target}")
    place = lambda n: F.floor(n.cast("double") * F.lit(1.0 - target))
    return ranks.values_at(scored.where(F.col(truth) == 1), by, score, {"threshold": place}).select(*by, "threshold").where("threshold is not null")


def checked(thresholds: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """thresholds, with an error for a group that has none."""
    joined = groups.select(*by).distinct().join(thresholds, by, "left")
    return joined.withColumn("threshold", F.coalesce("threshold", F.raise_error(F.lit("no positives: the recall can't be calibrated")).cast("double")))


def metrics_at(scored: DataFrame, thresholds: DataFrame, by: list[str], score: str = "score", truth: str = "truth") -> DataFrame:
    """Metrics with score >= the group's threshold. thresholds: a row for each group (or few)."""
    joined = scored.join(F.broadcast(thresholds), by) if by else scored.crossJoin(F.broadcast(thresholds))
    return with_rates(joined.groupBy(*by, "threshold").agg(*counts(F.col(truth) == 1, F.col(score) >= F.col("threshold"))))


def threshold_sweep(scored: DataFrame, by: list[str], baked: float, min_precision: float, min_recall: float, score: str = "score", truth: str = "truth") -> DataFrame:
    """Metrics at every positive score (to 4 digits) and at the baked threshold -2, -1, 0 and +1, those that reach both limits; is_baked marks it.

    Counts at a candidate are running sums: candidates and scores are ordered together once."""
    finite = (F.col(truth) == 1) & (F.col(score) > float("-inf")) & (F.col(score) < float("inf"))
    observed = scored.where(finite).select(*by, F.bround(score, 4).alias("at")).distinct()
    offsets = F.explode(F.array(*[F.lit(baked + d) for d in (-2.0, -1.0, 0.0, 1.0)])).alias("at")
    groups = scored.select(*by).distinct()
    candidates = observed.unionByName(groups.select(*by, offsets)).distinct()
    at = scored.groupBy(*by, F.col(score).alias("at")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    both = at.withColumn("asks", F.lit(0)).unionByName(candidates.withColumns({"p": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "asks": F.lit(1)}))
    swept = ranks.running(both, by, "at", {"tp": F.col("p"), "fp": F.col("n")}, descending=True, then=("asks",))
    swept = swept.where("asks = 1").withColumnsRenamed({"tp_all": "pos", "fp_all": "neg"})
    swept = with_rates(swept.withColumn("fn", F.col("pos") - F.col("tp")).withColumn("tn", F.col("neg") - F.col("fp")))
    passed = swept.where((F.col("precision") >= min_precision) & (F.col("recall") >= min_recall))
    return passed.select(*by, F.col("at").alias("threshold"), "tp", "fp", "fn", "tn", "precision", "recall", "f1", (F.abs(F.col("at") - baked) < 1e-3).alias("is_baked"))


def latency_summary(runs: DataFrame, total: str, parts: list[str], warmup: int, order: str, frames: str | None = None) -> DataFrame:
    """p50 and p95 (linear), mean, min and max of each stage, without the first `warmup` runs: the total, its parts, what is left of it, and the time a frame."""
    kept = runs.join(F.broadcast(runs.select(order).orderBy(order).limit(warmup)), order, "left_anti")
    stages = {"total": F.col(total), **{p: F.col(p) for p in parts}, "other": F.col(total) - sum((F.col(p) for p in parts), F.lit(0.0))}
    if frames:
        stages["per_frame"] = F.try_divide(F.col(total), F.col(frames))
    each = kept.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), v.cast("double").alias("ms")) for k, v in stages.items()])).alias("x")).select("x.*")
    return stage_summary(each)


def stage_summary(each: DataFrame) -> DataFrame:
    """p50, p95, mean, min and max of rows (stage, ms)."""
    found = each.groupBy("stage").agg(F.avg("ms").alias("mean"), F.min("ms").alias("min"), F.max("ms").alias("max"), F.count("ms").alias("n"))
    places = ranks.percentiles(each, ["stage"], "ms", {"p50": 0.5, "p95": 0.95}).drop("n").withColumnRenamed("stage", "of")
    return found.join(places, F.col("stage").eqNullSafe(F.col("of")), "left").select("stage", "p50", "p95", "mean", "min", "max", "n")


def union_results(results: dict[str, DataFrame], label: str = "split") -> DataFrame:
    """Result tables of several splits or models as one, each row under its name; columns that a table lacks are null."""
    found = None
    for name, rows in results.items():
        one = rows.withColumn(label, F.lit(name))
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    if found is None:
        raise ValueError("no results to unite")
    return found


def training_curves(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mean train loss of each epoch, validation row of each epoch with is_best, the first highest val_f1)."""
    train = log.where("train_loss is not null").groupBy("epoch").agg(F.avg("train_loss").alias("train_loss"))
    val = log.where("val_f1 is not null").groupBy("epoch").agg(F.max_by("val_f1", "step").alias("val_f1"))
    best = val.agg(F.max(F.struct("val_f1", (-F.col("epoch")).alias("minus"))).alias("b")).select((-F.col("b.minus")).alias("best"))
    return train, val.crossJoin(F.broadcast(best)).withColumn("is_best", F.col("epoch") == F.col("best")).drop("best")


def ttd_histogram(results: DataFrame, by: list[str], bins: int = 20, truth: str = "is_positive_gt", predicted: str = "is_positive", trigger: str = "trigger_frame_index") -> DataFrame:
    """Equal-width bins of the frames to detection of true positives: bin (from 0), low, high, n and the group's mean."""
    late = results.select(*by, ttd(truth, predicted, trigger).cast("double").alias("ttd")).where("ttd is not null")
    limits = late.groupBy(*by).agg(F.min("ttd").alias("least"), F.max("ttd").alias("most"), F.avg("ttd").alias("mean_ttd"))
    joined = late.join(F.broadcast(limits), by)
    low = F.when(F.col("most") > F.col("least"), F.col("least")).otherwise(F.col("least") - 0.5)
    wide = F.when(F.col("most") > F.col("least"), F.col("most") - F.col("least")).otherwise(1.0)
    at = F.least(F.lit(bins - 1), F.floor((F.col("ttd") - low) / wide * bins)).cast("int")
    return joined.groupBy(*by, at.alias("bin"), (low + at * wide / bins).alias("low"), (low + (at + 1) * wide / bins).alias("high"), "mean_ttd").agg(F.count("*").alias("n"))


def variant_comparison(scored: DataFrame, by: str = "variant", targets: tuple[float, ...] = (0.90, 0.95, 0.97, 0.99)) -> DataFrame:
    """F1 at 0.5, areas and false positives at target recalls of each variant, in one row."""
    points = curve(scored, [by])
    wide = fp_at_recall(scored, [by], list(targets)).groupBy(by).agg(*[F.max(F.when(F.col("target") == t, F.col("fp"))).alias(f"fp_at_{round(t * 100)}") for t in targets])
    return classifier_metrics(scored, [by]).select(by, "f1").join(average_precision(points, [by]), by).join(roc_auc(points, [by]), by).join(wide, by)


def noise_floor(compared: DataFrame, seeds: list[str], by: str = "variant") -> DataFrame:
    """Spread (largest minus least) of each metric over variants that differ in their seed only."""
    columns = [c for c in compared.columns if c != by]
    return compared.where(F.col(by).isin(*seeds)).agg(*[(F.max(c) - F.min(c)).alias(f"{c}_spread") for c in columns])
