"""Repeatable random numbers, keyed by columns instead of by task or time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 1 << 52


def uniform(seed: int, *parts) -> Column:
    """Number in (0, 1) that depends only on ``seed`` and ``parts``."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    h = F.xxhash64(F.lit(seed).cast("bigint"), *cols)
    return (F.pmod(h, F.lit(_BITS)) + F.lit(0.5)) / F.lit(float(_BITS))


def gaussian(seed: int, *parts) -> Column:
    """Standard normal by the Box-Muller transform."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(seed, *parts, "radius")))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed, *parts, "angle"))
