"""Box geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    """The columns cx, cy, w, h under a prefix."""
    return tuple(F.col(f"{prefix}{c}") for c in ("cx", "cy", "w", "h"))


def corners(cx, cy, w, h) -> tuple[Column, Column, Column, Column]:
    """x1, y1, x2, y2 of a centre box."""
    cx, cy, w, h = map(_col, (cx, cy, w, h))
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def top_left(cx, cy, w, h) -> tuple[Column, Column, Column, Column]:
    """x, y, w, h with x, y the top left corner."""
    cx, cy, w, h = map(_col, (cx, cy, w, h))
    return cx - w / 2, cy - h / 2, w, h


def area(w, h) -> Column:
    return _col(w) * _col(h)


def area_ratio(first, last) -> Column:
    """last / first, 0 where first isn't above 0."""
    return F.when(_col(first) > 0, _col(last) / _col(first)).otherwise(0.0)


def iou(one, two) -> Column:
    """Intersection over union of two centre boxes (cx, cy, w, h); 0 where the union isn't above 0."""
    ax1, ay1, ax2, ay2 = corners(*one)
    bx1, by1, bx2, by2 = corners(*two)
    zero = F.lit(0.0)
    both = F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(zero, F.least(ay2, by2) - F.greatest(ay1, by1))
    union = area(one[2], one[3]) + area(two[2], two[3]) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def expand(w, h, factor: float) -> tuple[Column, Column]:
    """Width and height with more context around the centre."""
    return _col(w) * factor, _col(h) * factor


def pixel_square(cx, cy, w, h, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """x0, y0, x1, y1 in pixels of the square on the larger side, rounded half to even and clamped to the image."""
    cx, cy, w, h = map(_col, (cx, cy, w, h))
    half = F.greatest(w * width, h * height) / 2
    edge = lambda at, most: F.greatest(F.lit(0), F.least(F.lit(most), F.bround(at, 0).cast("int")))
    return edge(cx * width - half, width), edge(cy * height - half, height), edge(cx * width + half, width), edge(cy * height + half, height)


def pixel_rectangle(cx, cy, w, h, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """x0, y0, x1, y1 in pixels by truncation, clamped to the image."""
    x1, y1, x2, y2 = corners(cx, cy, w, h)
    edge = lambda at, most: F.greatest(F.lit(0), F.least(F.lit(most), at.cast("int")))
    return edge(x1 * width, width), edge(y1 * height, height), edge(x2 * width, width), edge(y2 * height, height)
