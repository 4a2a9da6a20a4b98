"""Pluggable sequence models, their registry and evaluation, the logistic calibrator, the frame scorer hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import calibrated
from . import ranks, shape, smoothing, tracking
from .joins import attach_truth
from .metrics import sequence_metrics
from .tracking import by_sequence
from .tube_scores import FEATURES


class SequenceModel(Protocol):
    """From frames in long form (sequence_id, frame_idx, det_idx, box, confidence; empty frames kept) to sequence_id, is_positive, trigger_frame_index, details."""

    def transform(self, frames: DataFrame) -> DataFrame: ...


def _sequences(frames: DataFrame) -> DataFrame:
    return frames.select("sequence_id").distinct()


class TrackerModel:
    """Confirmed tracks raise the alarm."""

    def __init__(self, min_confidence: float = 0.3, min_iou: float = 0.1, max_misses: int = 1, min_consecutive: int = 3, min_length: int = 0, **post_filters):
        self.min_confidence, self.min_length = min_confidence, min_length
        self.tracker = {"min_iou": min_iou, "max_misses": max_misses, "min_consecutive": min_consecutive, **post_filters}

    def transform(self, frames: DataFrame) -> DataFrame:
        slots = frames.select("sequence_id", "frame_idx").distinct()
        if self.min_length:
            slots = shape.pad_symmetric(slots, self.min_length).select("sequence_id", F.col("slot").alias("at"), "frame_idx")
        else:
            slots = slots.withColumn("at", F.col("frame_idx"))
        kept = frames.where((F.col("det_idx").isNotNull()) & (F.col("confidence") >= self.min_confidence))
        rows = slots.join(kept, ["sequence_id", "frame_idx"], "left").drop("frame_idx").withColumnRenamed("at", "frame_idx")
        found = tracking.alarms(tracking.track(rows, **self.tracker), _sequences(frames))
        return found.select("sequence_id", "is_positive", "trigger_frame_index", F.to_json(F.struct("n_tracks")).alias("details"))


class SmoothingModel:
    """Smoothed confidence above a threshold raises the alarm."""

    def __init__(self, window: int = 8, threshold: float = 0.3):
        self.window, self.threshold = window, threshold

    def transform(self, frames: DataFrame) -> DataFrame:
        found = smoothing.smoothed_alarms(frames.where("det_idx is not null"), _sequences(frames), self.window, self.threshold)
        return found.select("sequence_id", "is_positive", "trigger_frame_index", F.lit("{}").alias("details"))


class PythonModel:
    """A Python function of one sequence's frames, (is_positive, trigger, details JSON), run in a grouped kernel."""

    def __init__(self, predict: Callable[[pd.DataFrame], tuple[bool, int | None, str]]):
        self.predict = predict

    def transform(self, frames: DataFrame) -> DataFrame:
        predict = self.predict

        def kernel(rows: pd.DataFrame) -> pd.DataFrame:
            positive, trigger, details = predict(rows.sort_values(["frame_idx", "det_idx"]))
            return pd.DataFrame({"sequence_id": [rows["sequence_id"].iloc[0]], "is_positive": [positive], "trigger_frame_index": pd.array([trigger], "Int32"), "details": [details]})

        kind = frames.schema["sequence_id"].dataType.simpleString()
        return by_sequence(frames).groupBy("sequence_id").applyInPandas(kernel, f"sequence_id {kind}, is_positive boolean, trigger_frame_index int, details string")


class Registry:
    """Models by name."""

    def __init__(self):
        self.makers: dict[str, Callable[..., SequenceModel]] = {}

    def register(self, name: str, maker: Callable[..., SequenceModel]) -> None:
        self.makers[name] = maker

    def load(self, name: str, **parameters) -> SequenceModel:
        if name not in self.makers:
            raise KeyError(f"unknown model {name!r}; one of {sorted(self.makers)}")
        return self.makers[name](**parameters)

    def evaluate(self, frames: DataFrame, truth: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
        """(predictions of all models with truth, metrics of each)."""
        results = None
        for name in names:
            one = attach_truth(self.load(name).transform(frames), truth).withColumn("model_name", F.lit(name))
            results = one if results is None else results.unionByName(one)
        return results, sequence_metrics(results, ["model_name"])


REGISTRY = Registry()
REGISTRY.register("tracker", TrackerModel)
REGISTRY.register("sliding-window", SmoothingModel)


def score_frames(frames: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """A detector as a black box: load() runs once a task and returns a function of batches of frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            yield scorer(batch)

    return frames.mapInPandas(run, schema)


def fit_calibrator(features: DataFrame, truth: str = "truth", c: float = 1.0) -> tuple[list[float], float]:
    """Coefficients of FEATURES and intercept of a logistic regression with L2 strength 1 / c, intercept free."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    found = {r[0]: r[1] for r in features.groupBy(truth).count().collect()}
    if len(found) < 2:
        raise ValueError("a calibrator needs both classes")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features.withColumn("label", F.col(truth).cast("double")))
    model = LogisticRegression(regParam=1 / (c * sum(found.values())), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-10).fit(rows)
    return [float(x) for x in model.coefficients], float(model.intercept)


def loss_slope(features: DataFrame, coefficients: list[float], intercept: float, truth: str = "truth", c: float = 1.0) -> DataFrame:
    """feature, slope: the derivative of the calibrator's loss by each coefficient and the intercept; all zero where it is fitted."""
    off = calibrated(FEATURES, coefficients, intercept) - F.col(truth)
    sums = [(F.sum(off * F.col(f)) + w / c).alias(f) for f, w in zip(FEATURES, coefficients)] + [F.sum(off).alias("intercept")]
    return features.agg(*sums).unpivot([], [*FEATURES, "intercept"], "feature", "slope")


def sanity_rows(features: DataFrame, coefficients: list[float], intercept: float) -> DataFrame:
    """Three rows that span the probabilities: lowest, middle and highest, with their probability."""
    scored = features.select(*FEATURES, calibrated(FEATURES, coefficients, intercept).alias("prob"))
    distinct = scored.groupBy("prob").agg(F.min(F.struct(*FEATURES)).alias("x"))
    middle = ranks.values_at(distinct, [], "prob", {"middle": lambda n: F.ceil(n / 2) - 1}).first()["middle"]
    at = lambda order: distinct.orderBy(order).limit(1)
    picked = at(F.asc("prob")).unionByName(distinct.where(F.col("prob") == F.lit(middle)).limit(1)).unionByName(at(F.desc("prob")))
    return picked.select("x.*", "prob").distinct()


def verify(rows: DataFrame, coefficients: list[float], intercept: float, tolerance: float = 1e-6) -> None:
    """Raises if a sanity row's probability isn't what the coefficients give."""
    off = rows.agg(F.max(F.abs(calibrated(FEATURES, coefficients, intercept) - F.col("prob")))).first()[0]
    if off is None or off > tolerance:
        raise ValueError(f"calibrator differs from its sanity rows by {off}")
