"""Small column expressions: times, scores, labels and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import _col

#: The time that ends a frame's name.
STAMP = r"(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2})"


def frame_time(frame_id, strict: bool = False, anchored: bool = True) -> Column:
    """Timestamp in a frame id, at its end unless not anchored. Without one: null, or in strict mode an error."""
    text = F.regexp_extract(_col(frame_id), STAMP + ("$" if anchored else ""), 1)
    found = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH-mm-ss"))
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no timestamp in frame id "), F.coalesce(_col(frame_id), F.lit("null")))).cast("timestamp"))


def logit(p) -> Column:
    return F.ln(_col(p) / (1 - _col(p)))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_col(x)))


def calibrated(features, coefficients: list[float], intercept: float) -> Column:
    """Probability of a feature row: a list of columns."""
    return sigmoid(sum((_col(f) * float(c) for f, c in zip(features, coefficients, strict=True)), F.lit(float(intercept))))


def outcome(truth, predicted) -> Column:
    """TP, FP, FN or TN."""
    t, p = _col(truth), _col(predicted)
    return F.when(t & p, "TP").when(~t & p, "FP").when(t & ~p, "FN").when(~t & ~p, "TN")


def error_kind(truth, predicted) -> Column:
    """false_positive, false_negative, or null where the prediction is right."""
    t, p = _col(truth), _col(predicted)
    return F.when(~t & p, "false_positive").when(t & ~p, "false_negative")


def sequence_score(logits, empty: float | None = float("-inf")) -> Column:
    """Largest tube logit; `empty` for a sequence without tubes."""
    return F.coalesce(F.array_max(_col(logits)), F.lit(empty).cast("double"))


def ttd(truth, predicted, trigger) -> Column:
    """Frames to detection, of true positives with a trigger only."""
    return F.when(_col(truth) & _col(predicted), _col(trigger))


def rate(part, whole) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(_col(part).cast("double"), _col(whole).cast("double")), F.lit(0.0))


def percent(part, whole, digits: int = 2) -> Column:
    return F.bround(rate(part, whole) * 100, digits)


def f1(precision, recall) -> Column:
    return rate(2 * _col(precision) * _col(recall), _col(precision) + _col(recall))
