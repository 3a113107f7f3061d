"""Column expressions on axis-aligned boxes ``(x1, y1, x2, y2)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple  # four Columns


def box(alias: str | None = None) -> Box:
    prefix = f"{alias}." if alias else ""
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def fields(struct: Column) -> Box:
    return tuple(struct[c] for c in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    x1, y1, x2, y2 = b
    return (x2 - x1) * (y2 - y1)


def intersection(a: Box, b: Box) -> Column:
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))


def may_overlap(a: Box, b: Box) -> Column:
    """False for most pairs apart, after a comparison or two; true wherever the intersection is above 0."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def overlaps_more_than(a: Box, b: Box, threshold: float) -> Column:
    """IoU above ``threshold``, multiplied out so that no division is needed."""
    inter = intersection(a, b).cast("double")
    return (inter > 0) & (inter > F.lit(float(threshold)) * (area(a) + area(b) - inter))


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b).cast("double")
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low,
                      F.least(value, F.lit(high) if not isinstance(high, Column) else high))
