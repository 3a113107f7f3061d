"""Field masks as run-length rows and field contours as closed polygons of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..settings import FIELD
from .ordered import chunk_of, neighbour_rows
from .support import cut_lineage, map_groups, spread

FRAME = ("video_id", "frame_idx")
CONTOUR = ("video_id", "frame_idx", "contour_id")
TASK_RUNS = 500_000  # runs of a mask in one task


def union_masks(runs: DataFrame, keys=FRAME) -> DataFrame:
    """Merge the runs of all classes into disjoint runs per scanline (``x_end`` exclusive).

    Runs with the same start are reduced to the longest first, so a scanline
    never holds more rows than the frame has columns. Scanlines are dealt once, over as many tasks
    as keep each to about ``TASK_RUNS`` runs; all steps on a scanline then stay in its task.
    """
    line = [*keys, "y"]
    longest = (
        spread(runs.filter(F.col("x_end") > F.col("x_start")).select(*line, "x_start", "x_end"), *line, most=TASK_RUNS)
        .groupBy(*line, "x_start")
        .agg(F.max("x_end").alias("x_end"))
    )
    w = W.partitionBy(*line).orderBy("x_start")
    reach = F.max("x_end").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col("x_start") > reach)).cast("int")
    islands = longest.withColumn("__new", fresh).withColumn("__island", F.sum("__new").over(w))
    return (
        islands.groupBy(*line, "__island")
        .agg(F.min("x_start").alias("x_start"), F.max("x_end").alias("x_end"))
        .drop("__island")
    )


def mask_area(runs: DataFrame, keys=FRAME) -> DataFrame:
    """Pixels covered per frame by any class."""
    return union_masks(runs, keys).groupBy(*keys).agg(
        F.sum(F.col("x_end") - F.col("x_start")).cast("bigint").alias("area")
    )


def class_shares(runs: DataFrame, keys=FRAME) -> DataFrame:
    """Pixels of each class per frame and their share of all class pixels of the frame."""
    per_class = mask_area(runs, (*keys, "class_id"))
    total = F.sum("area").over(W.partitionBy(*keys))
    return per_class.withColumn("share", F.col("area") / total)


def contour_measures(points: DataFrame, keys=CONTOUR) -> DataFrame:
    """Points, enclosed area and perimeter of each closed contour.

    Sums run per chunk of points; only the edges that join two chunks, and the
    closing edge, are added over the chunk summaries.
    """
    keys = list(keys)
    d = points.withColumn("__chunk", chunk_of("pt_idx"))
    w = W.partitionBy(*keys, "__chunk").orderBy("pt_idx")
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    d = d.withColumns(
        {
            "__cross": F.col("x") * ny - nx * F.col("y"),
            "__len": F.hypot(nx - F.col("x"), ny - F.col("y")),
            "__first": F.row_number().over(w) == 1,
            "__last": nx.isNull(),
        }
    )

    def at(flag, column):
        return F.max(F.when(F.col(flag), F.col(column)))

    parts = d.groupBy(*keys, "__chunk").agg(
        F.count("*").alias("__n"),
        F.coalesce(F.sum("__cross"), F.lit(0.0)).alias("__cross"),
        F.coalesce(F.sum("__len"), F.lit(0.0)).alias("__len"),
        at("__first", "x").alias("fx"), at("__first", "y").alias("fy"),
        at("__last", "x").alias("lx"), at("__last", "y").alias("ly"),
    )
    across = W.partitionBy(*keys).orderBy("__chunk")
    whole = across.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    gx = F.coalesce(F.lead("fx").over(across), F.first("fx").over(whole))
    gy = F.coalesce(F.lead("fy").over(across), F.first("fy").over(whole))
    parts = parts.withColumns(
        {
            "__cross": F.col("__cross") + F.col("lx") * gy - gx * F.col("ly"),
            "__len": F.col("__len") + F.hypot(gx - F.col("lx"), gy - F.col("ly")),
        }
    )
    return parts.groupBy(*keys).agg(
        F.sum("__n").cast("bigint").alias("points"),
        (F.abs(F.sum("__cross")) / 2).alias("area"),
        F.sum("__len").alias("perimeter"),
    )


def largest_contour(
    measures: DataFrame, min_area: float = FIELD.min_contour_area, keys=FRAME
) -> DataFrame:
    """The biggest contour of each frame (lowest id on a tie), if it reaches ``min_area``."""
    big = measures.filter(F.col("area") >= min_area)
    best = big.groupBy(*keys).agg(
        F.max(F.struct("area", (-F.col("contour_id")).alias("o"), "points", "perimeter")).alias("b")
    )
    return best.select(
        *keys, (-F.col("b.o")).alias("contour_id"), "b.area", "b.points", "b.perimeter"
    )


def _perpendicular(x, y, ax, ay, bx, by):
    """Squared distance to the line a-b times the squared length, and that squared length."""
    dx, dy = bx - ax, by - ay
    cross = (y - ay) * dx - (x - ax) * dy
    return cross * cross, dx * dx + dy * dy


def _far_ends(x: np.ndarray, y: np.ndarray) -> tuple[int, int, float]:
    """Two far ends of a closed polygon and their squared distance."""
    n = len(x)
    pos = far = 0
    gap = 0.0
    for _ in range(3):  # three sweeps settle on them
        pos = far
        d = (x - x[pos]) ** 2 + (y - y[pos]) ** 2
        d = np.concatenate([d[pos:], d[:pos]])
        j = int(d.argmax())
        gap, far = float(d[j]), (pos + j) % n
    return pos, far, gap


def _simplify(x: np.ndarray, y: np.ndarray, starts: np.ndarray, epsilon: float) -> np.ndarray:
    """Which points Douglas-Peucker keeps of closed polygons that lie one after the other.

    All stretches of all polygons are split at once, level by level.
    """
    kept = np.zeros(len(x), bool)
    rings, at, lows, highs, limits, base = [], [], [], [], [], 0
    for a, b in zip(starts[:-1], starts[1:]):
        px, py, n = x[a:b], y[a:b], b - a
        eps = epsilon * float(np.hypot(np.roll(px, -1) - px, np.roll(py, -1) - py).sum())
        pos, far, gap = _far_ends(px, py)
        kept[a + pos] = True
        if gap <= eps * eps:
            continue
        kept[a + far] = True
        middle = (far - pos) % n
        t = np.arange(1, n)
        t = t[t != middle]
        rings.append(a + (np.arange(n + 1) + pos) % n)
        at.append(base + t)
        lows.append(base + np.where(t < middle, 0, middle))
        highs.append(base + np.where(t < middle, middle, n))
        limits.append(np.full(len(t), eps * eps))
        base += n + 1
    if not at:
        return kept
    ring = np.concatenate(rings)
    rx, ry = x[ring], y[ring]
    p, lo, hi, limit = (np.concatenate(parts) for parts in (at, lows, highs, limits))
    while len(p):
        d, length = _perpendicular(rx[p], ry[p], rx[lo], ry[lo], rx[hi], ry[hi])
        first = np.r_[0, np.flatnonzero(lo[1:] != lo[:-1]) + 1]
        stretch = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(p)]))
        top = np.flatnonzero(d == np.maximum.reduceat(d, first)[stretch])
        which, once = np.unique(stretch[top], return_index=True)
        top = top[once]
        split = d[top] > limit[top] * length[top]
        cut = np.full(len(first), -1)
        cut[which[split]] = p[top[split]]
        kept[ring[cut[cut >= 0]]] = True
        cut = cut[stretch]
        go = (cut >= 0) & (p != cut)
        p, lo, hi, limit, cut = p[go], lo[go], hi[go], limit[go], cut[go]
        lo, hi = np.where(p > cut, cut, lo), np.where(p < cut, cut, hi)
    return kept


def simplify_contours(
    points: DataFrame, epsilon: float = FIELD.simplify_epsilon, keys=CONTOUR,
    group_limit: int = 50_000,
) -> DataFrame:
    """Drop points closer to the simplified outline than ``epsilon`` × perimeter.

    Contours up to ``group_limit`` points are simplified whole, as many at a time as a batch
    of rows holds; longer ones by rounds of splits over all their points at once.
    """
    keys = list(keys)
    points = points.select(*keys, "pt_idx", "x", "y")
    large = (
        points.groupBy(*keys).count().filter(F.col("count") > group_limit).select(*keys)
    )
    schema = points.schema

    def simplify(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        return pdf[_simplify(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), starts, epsilon)]

    if large.isEmpty():
        return map_groups(points, keys, ["pt_idx"], simplify, schema)
    out = map_groups(points.join(large, keys, "left_anti"), keys, ["pt_idx"], simplify, schema)
    long = points.join(large, keys, "left_semi")
    sizes = contour_measures(long, keys).select(
        *keys, (F.col("perimeter") * epsilon).alias("eps")
    )
    return out.unionByName(_simplify_by_rounds(long, sizes, keys))


def _simplify_by_rounds(points: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    big, end = 1 << 40, 1 << 41
    base = cut_lineage(points.join(sizes, keys))
    here = base.groupBy(*keys).agg(F.min(F.struct("pt_idx", "x", "y")).alias("far"))
    for _ in range(3):
        at = here.select(*keys, F.col("far.pt_idx").alias("p"), F.col("far.x").alias("px"),
                         F.col("far.y").alias("py"))
        t = F.col("pt_idx") - F.col("p")
        t = F.when(t >= 0, t).otherwise(t + big)
        away = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
        here = cut_lineage(
            base.join(at, keys).groupBy(*keys, "p", "px", "py", "eps").agg(
                F.max(F.struct(away.alias("d"), (-t).alias("o"), "pt_idx", "x", "y")).alias("far")
            )
        )
    ends = here.withColumn("split", F.col("far.d") > F.col("eps") * F.col("eps"))
    kept = ends.select(*keys, F.col("p").alias("pt_idx")).unionByName(
        ends.filter("split").select(*keys, F.col("far.pt_idx").alias("pt_idx"))
    )
    ends = ends.filter("split").select(
        *keys, "p", "px", "py", (-F.col("far.o")).alias("m"),
        F.col("far.x").alias("mx"), F.col("far.y").alias("my"),
    )
    t = F.col("pt_idx") - F.col("p")
    d = base.join(ends, keys).withColumn("t", F.when(t >= 0, t).otherwise(t + big))
    first = F.col("t") < F.col("m")
    d = d.filter((F.col("t") > 0) & (F.col("t") != F.col("m"))).select(
        *keys, "pt_idx", "t", "x", "y", "eps",
        F.when(first, 0).otherwise(F.col("m")).alias("lo"),
        F.when(first, F.col("m")).otherwise(end).alias("hi"),
        *[F.when(first, F.col(a)).otherwise(F.col(b)).alias(c)
          for c, a, b in (("ax", "px", "mx"), ("ay", "py", "my"),
                          ("bx", "mx", "px"), ("by", "my", "py"))],
    )
    d = cut_lineage(d)
    while not d.isEmpty():
        dist, length = _perpendicular(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
        split = (
            d.groupBy(*keys, "lo")
            .agg(
                F.max(F.struct(dist.alias("d"), (-F.col("t")).alias("o"), "pt_idx", "x", "y",
                               length.alias("l"), "eps")).alias("s")
            )
            .filter(F.col("s.d") > F.col("s.eps") * F.col("s.eps") * F.col("s.l"))
            .select(*keys, "lo", (-F.col("s.o")).alias("m"), F.col("s.pt_idx").alias("m_idx"),
                    F.col("s.x").alias("mx"), F.col("s.y").alias("my"))
        )
        split = cut_lineage(split)
        kept = kept.unionByName(split.select(*keys, F.col("m_idx").alias("pt_idx")))
        left = F.col("t") < F.col("m")
        d = d.join(split, [*keys, "lo"]).filter(F.col("t") != F.col("m")).select(
            *keys, "pt_idx", "t", "x", "y", "eps",
            F.when(left, F.col("lo")).otherwise(F.col("m")).alias("lo"),
            F.when(left, F.col("m")).otherwise(F.col("hi")).alias("hi"),
            *[F.when(left, F.col(a)).otherwise(F.col(b)).alias(c)
              for c, a, b in (("ax", "ax", "mx"), ("ay", "ay", "my"),
                              ("bx", "mx", "bx"), ("by", "my", "by"))],
        )
        d = cut_lineage(d)
    return points.join(kept.distinct(), [*keys, "pt_idx"], "left_semi")


def densify_contours(
    points: DataFrame,
    max_distance: float = FIELD.max_point_distance,
    min_distance: float = FIELD.min_point_distance,
    keys=CONTOUR,
) -> DataFrame:
    """Insert points so that no edge is longer than ``max_distance``.

    ``sub_idx`` is 0 for an input point and counts the points added after it.
    Added points keep at least ``min_distance`` from the one before.
    """
    d = neighbour_rows(points, keys, ["pt_idx"], ["x", "y"], "next_", step=1, wrap=True)
    dx, dy = F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y")
    length = F.sqrt(dx * dx + dy * dy)
    extra = F.when(length > max_distance, F.ceil(length / F.lit(float(max_distance))) - 1)
    extra = F.coalesce(extra, F.lit(0)).cast("bigint")
    spacing = length / (extra + 1)
    stride = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.try_divide(F.lit(float(min_distance)), spacing)))
    d = d.withColumns({"__extra": extra, "__stride": F.coalesce(stride, F.lit(1))})
    d = d.withColumn("sub_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), "__extra")))
    d = d.filter(F.col("sub_idx") % F.col("__stride") == 0)
    part = F.col("sub_idx") / (F.col("__extra") + 1)
    return d.select(
        *keys, "pt_idx", "sub_idx",
        (F.col("x") + part * (F.col("next_x") - F.col("x"))).alias("x"),
        (F.col("y") + part * (F.col("next_y") - F.col("y"))).alias("y"),
    )


def near_edge(width, height, margin: float = FIELD.edge_margin) -> Column:
    x, y = F.col("x"), F.col("y")
    inside = (x >= margin) & (x <= F.lit(width) - margin) & (y >= margin) & (
        y <= F.lit(height) - margin
    )
    return ~inside


def split_edge_points(
    points: DataFrame, width: int, height: int, margin: float = FIELD.edge_margin
) -> tuple[DataFrame, DataFrame]:
    """Points away from the frame border, and those within ``margin`` of it."""
    edge = near_edge(width, height, margin)
    return points.filter(~edge), points.filter(edge)
