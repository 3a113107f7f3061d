"""Robust line fitting on contour points, for all frames at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import line_band
from ..settings import FIELD
from .field import contour_measures, densify_contours, largest_contour, near_edge
from .support import cut_lineage, map_groups, salted_join, spread

FRAME = ("video_id", "frame_idx")
BLOCK = 4096
BATCH = 1 << 15  # numbers or distances worked out at once, few enough to stay near the processor

# Picking numbers: each (trial, point) gets a number below 2**22; the smallest wins a trial.
PRIME = 2147483647
FIRST, SECOND = (1000003, 7919), (998244353, 104729)


def _ticket(point_id: Column, trial: Column, seed: int, factors: tuple[int, int]) -> Column:
    """Picking number of a point in a trial, with the point's id packed below it."""
    a, b = factors
    h = (point_id % F.lit(PRIME) * F.lit(a) + (trial + F.lit(seed)) * F.lit(b)) % F.lit(PRIME)
    h = (h * h) % F.lit(PRIME) % F.lit(1 << 22)
    return h * F.lit(1 << 40) + point_id


def _id_of(ticket: Column) -> Column:
    return ticket % F.lit(1 << 40)


def distance_sq(line: Column, x: Column, y: Column) -> Column:
    d = line["a"] * x + line["b"] * y + line["c"]
    return d * d


def ransac_picks(points: DataFrame, trials: int, seed: int = 0, keys=FRAME) -> DataFrame:
    """Two different points for each trial: those with the smallest picking numbers."""
    trial = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(trials - 1).cast("bigint")))
    d = points.select(*keys, "point_id", trial.alias("trial"))
    one = _ticket(F.col("point_id"), F.col("trial"), seed, FIRST)
    two = _ticket(F.col("point_id"), F.col("trial"), seed, SECOND)
    picks = d.groupBy(*keys, "trial").agg(
        F.min(one).alias("t1"), F.min(two).alias("t2"), F.max(two).alias("t3")
    )
    first, second = _id_of(F.col("t1")), _id_of(F.col("t2"))
    return picks.select(
        *keys, "trial", first.alias("id_a"),
        F.when(second == first, _id_of(F.col("t3"))).otherwise(second).alias("id_b"),
    ).filter(F.col("id_a") != F.col("id_b"))


def _lines_through(picks: DataFrame, points: DataFrame, keys, block_size: int) -> DataFrame:
    """One normalised line ``a x + b y + c = 0`` per trial."""
    ends = picks.select(
        *keys, "trial", F.explode(F.array("id_a", "id_b")).alias("point_id"),
        F.col("id_a"),
    ).withColumn("block", _block_of(F.col("point_id"), block_size))
    both = points.select(*keys, "block", "point_id", "x", "y").join(
        ends.hint("shuffle_hash"), [*keys, "block", "point_id"]
    )
    is_a = F.col("point_id") == F.col("id_a")

    def of(flag, column):
        return F.max(F.when(flag, F.col(column)))

    pair = both.groupBy(*keys, "trial").agg(
        of(is_a, "x").alias("ax"), of(is_a, "y").alias("ay"),
        of(~is_a, "x").alias("bx"), of(~is_a, "y").alias("by"),
    )
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    norm = F.sqrt(dx * dx + dy * dy)
    return (
        pair.filter(dx * dx + dy * dy >= 1e-12)
        .withColumns({"a": -dy / norm, "b": dx / norm})
        .select(*keys, "trial", "a", "b",
                (-(F.col("a") * F.col("ax") + F.col("b") * F.col("ay"))).alias("c"))
    )


def _block_of(point_id: Column, size: int) -> Column:
    return F.floor(point_id / F.lit(size)).cast("bigint")


def _per_block(blocks: DataFrame, per_frame: DataFrame, keys) -> DataFrame:
    """Copy one row per frame to each block of the frame's points.

    The copies are the side to hash in the join that follows; the points stay
    where they are, spread by frame and block.
    """
    return blocks.join(per_frame, list(keys)).hint("shuffle_hash")


def _best_trial(
    points: DataFrame, blocks: DataFrame, trial_lines: DataFrame, distance: float, keys
) -> DataFrame:
    """The trial line with most inliers per frame (lowest trial on a tie), with its ends."""
    limit = F.lit(float(distance) ** 2)
    line = F.struct("trial", "a", "b", "c")
    per_frame = trial_lines.groupBy(*keys).agg(F.collect_list(line).alias("tried"))
    d = points.join(_per_block(blocks, per_frame, keys), [*keys, "block"])
    x, y = F.col("x"), F.col("y")
    hits = d.select(*keys, "x", "y", F.explode("tried").alias("l"))
    hits = hits.filter(distance_sq(F.col("l"), x, y) <= limit)
    stats = hits.groupBy(*keys, "l.trial", "l.a", "l.b", "l.c").agg(
        F.count("*").alias("inliers"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"),
    )
    best = stats.groupBy(*keys).agg(
        F.max(F.struct("inliers", (-F.col("trial")).alias("o"), "a", "b", "c",
                       "x_min", "x_max", "y_min", "y_max")).alias("s")
    ).select(*keys, "s.*")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    steep = F.abs(b) <= 1e-6
    at_x = -c / F.when(a != 0, a)
    return best.select(
        *keys, (-F.col("o")).alias("trial"), "inliers", "a", "b", "c",
        F.when(steep, at_x).otherwise(F.col("x_min")).alias("x1"),
        F.when(steep, F.col("y_min")).otherwise(-(a * F.col("x_min") + c) / b).alias("y1"),
        F.when(steep, at_x).otherwise(F.col("x_max")).alias("x2"),
        F.when(steep, F.col("y_max")).otherwise(-(a * F.col("x_max") + c) / b).alias("y2"),
    )


FITTED = (
    "line_idx BIGINT, trial BIGINT, inliers BIGINT, a DOUBLE, b DOUBLE, c DOUBLE, "
    "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
)


def _rest(numbers: np.ndarray, factor: int) -> np.ndarray:
    return (numbers % PRIME * factor % PRIME).astype(np.uint32)


def _numbers(of_id: np.ndarray, of_trial: np.ndarray) -> np.ndarray:
    """Picking numbers, without the ids below them, of all ids in all trials by the rests of both.

    PRIME is 2**31 - 1: a remainder by it is the sum of 31-bit halves, and a sum of two remainders
    less PRIME wraps round to a larger number if it was below.
    """
    prime = np.uint32(PRIME)
    h = of_id[None, :] + of_trial[:, None]
    np.minimum(h, h - prime, out=h)
    square = np.multiply(h, h, dtype=np.uint64)
    h = square.astype(np.uint32)
    h &= prime
    square >>= np.uint64(31)
    h += square.astype(np.uint32)
    np.minimum(h, h - prime, out=h)
    h &= np.uint32((1 << 22) - 1)
    return h


def _picks(of_ids: list[np.ndarray], of_trials: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of each trial's two points among ascending ids: of equal numbers the lower id's is less."""
    first = _numbers(of_ids[0], of_trials[0]).argmin(axis=1)
    numbers = _numbers(of_ids[1], of_trials[1])
    second = numbers.argmin(axis=1)
    same = np.flatnonzero(second == first)
    second[same] = numbers.shape[1] - 1 - numbers[same, ::-1].argmax(axis=1)
    return first, second


def _fit_frame(
    ids: np.ndarray, x: np.ndarray, y: np.ndarray, num_lines: int, distance: float, trials: int,
    seed: int,
) -> list[tuple]:
    """All rounds for one frame's points, in ascending order of ids."""
    out, limit = [], float(distance) ** 2
    of_ids = [_rest(ids, a) for a, _ in (FIRST, SECOND)]
    for n in range(num_lines):
        if len(x) < 2:
            break
        rounds = np.arange(trials, dtype=np.int64) + seed + n * trials
        of_trials = [_rest(rounds, b) for _, b in (FIRST, SECOND)]
        step = max(1, BATCH // len(x))
        parts = [slice(i, i + step) for i in range(0, trials, step)]
        picked = [_picks(of_ids, [rests[part] for rests in of_trials]) for part in parts]
        first, second = (np.concatenate(ends) for ends in zip(*picked))
        dx, dy = x[second] - x[first], y[second] - y[first]
        square = dx * dx + dy * dy
        good = (first != second) & (square >= 1e-12)
        if not good.any():
            break
        norm = np.sqrt(np.where(good, square, 1.0))
        a, b = -dy / norm, dx / norm
        c = -(a * x[first] + b * y[first])

        def near(part: slice) -> np.ndarray:
            d = a[part, None] * x[None, :]
            d += b[part, None] * y[None, :]
            d += c[part, None]
            d *= d
            return d <= limit

        counts = np.where(good, np.concatenate([np.count_nonzero(near(part), axis=1) for part in parts]), 0)
        k = int(counts.argmax())
        hit = near(slice(k, k + 1))[0]
        xs, ys = (x[hit].min(), x[hit].max()), (y[hit].min(), y[hit].max())
        if abs(b[k]) <= 1e-6:
            xs = (-c[k] / a[k],) * 2
        else:
            ys = tuple(-(a[k] * v + c[k]) / b[k] for v in xs)
        out.append((n, k, int(counts[k]), a[k], b[k], c[k], xs[0], ys[0], xs[1], ys[1]))
        x, y, of_ids = x[~hit], y[~hit], [rests[~hit] for rests in of_ids]
    return out


def fit_lines_ransac(
    points: DataFrame,
    num_lines: int = FIELD.num_lines,
    distance: float = FIELD.line_distance,
    trials: int = FIELD.trials,
    seed: int = 0,
    min_samples: int = FIELD.min_samples,
    min_points: int | None = None,
    keys=FRAME,
    block_size: int = BLOCK,
    group_limit: int = 20_000,
) -> DataFrame:
    """Fit up to ``num_lines`` lines per frame to ``(point_id, x, y)``, best first.

    Each round draws point pairs, counts inliers within ``distance`` of each trial
    line, keeps the best and sets its inliers aside. Frames with fewer than
    ``min_points`` points are left out (default ``num_lines * min_samples``).

    A frame up to ``group_limit`` points runs all its rounds in one place after a
    single shuffle. Larger ones are never gathered: their rounds run over the
    points of all of them, spread by blocks of ids, with the same result.
    """
    keys = list(keys)
    need = num_lines * min_samples if min_points is None else min_points
    points = points.select(*keys, "point_id", "x", "y")
    large = (
        points.groupBy(*keys).count()
        .filter((F.col("count") > group_limit) & (F.col("count") >= need)).select(*keys)
    )

    def points_of(group: pd.DataFrame):
        return group["point_id"].to_numpy(np.int64), group["x"].to_numpy(float), group["y"].to_numpy(float)

    settings = (num_lines, distance, trials, seed)
    if large.isEmpty():
        return _fit_groups(points, keys, ["point_id"], points_of, need, settings)
    fitted = _fit_groups(points.join(large, keys, "left_anti"), keys, ["point_id"], points_of, need, settings)
    rest = _fit_by_rounds(
        points.join(large, keys, "left_semi"), num_lines, distance, trials, seed, keys, block_size
    )
    return fitted.unionByName(rest)


def _fit_groups(rows: DataFrame, keys: list[str], order: list[str], points_of, need: int, settings: tuple) -> DataFrame:
    """Lines of whole frames: ``points_of`` a frame's sorted rows are its ids, x and y."""
    names = [c.split()[0] for c in FITTED.split(", ")]
    key_ddl = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def fit(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        lines, owners = [], []
        for a, b in zip(starts[:-1], starts[1:]):
            ids, x, y = points_of(pdf.iloc[a:b])
            if len(ids) >= need:
                lines += _fit_frame(ids, x, y, *settings)
                owners += [a] * (len(lines) - len(owners))
        of = pdf[keys].iloc[owners].reset_index(drop=True)
        return pd.concat([of, pd.DataFrame(lines, columns=names)], axis=1)

    return map_groups(rows, keys, order, fit, f"{key_ddl}, {FITTED}")


def _fit_by_rounds(
    points: DataFrame, num_lines: int, distance: float, trials: int, seed: int, keys,
    block_size: int,
) -> DataFrame:
    base = points.withColumn("block", _block_of(F.col("point_id"), block_size))
    base = cut_lineage(spread(base, *keys, "block"))
    blocks = cut_lineage(base.select(*keys, "block").distinct())
    left, found = base, []
    for n in range(num_lines):
        picks = ransac_picks(left, trials, seed + n * trials, keys)
        tried = _lines_through(picks, left, keys, block_size)
        best = cut_lineage(_best_trial(left, blocks, tried, distance, keys))
        best = best.withColumn("line_idx", F.lit(n).cast("bigint"))
        found.append(best)
        if n + 1 < num_lines:
            # A frame that found no line drops out here and gets no more rounds.
            side = _per_block(blocks, best.select(*keys, F.struct("a", "b", "c").alias("l")), keys)
            far = distance_sq(F.col("l"), F.col("x"), F.col("y")) > float(distance) ** 2
            left = cut_lineage(left.join(side, [*keys, "block"]).filter(far).drop("l"))
    out = found[0]
    for lines in found[1:]:
        out = out.unionByName(lines)
    return out


def assign_points(
    points: DataFrame, lines: DataFrame, distance: float = FIELD.line_distance, keys=FRAME
) -> DataFrame:
    """Give each point the first line within ``distance``; null for the outliers."""
    keys = list(keys)
    limit = F.lit(float(distance) ** 2)
    line = F.struct("line_idx", "a", "b", "c")
    per_frame = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("__lines"))
    d = points.join(per_frame, keys, "left")
    near = F.filter("__lines", lambda t: distance_sq(t, F.col("x"), F.col("y")) <= limit)
    return d.withColumn("line_idx", F.get(near, F.lit(0))["line_idx"]).drop("__lines")


def line_confidence(
    lines: DataFrame, contour_sizes: DataFrame, num_lines: int = FIELD.num_lines, keys=FRAME
) -> DataFrame:
    """Share of the points a line was expected to explain, at most .95; .3 without inliers.

    ``contour_sizes`` holds ``points`` of the contour before densifying. The
    plain ``inlier_ratio`` stands beside it.
    """
    expected = F.greatest(F.lit(1), F.floor(F.col("points") / F.lit(num_lines)))
    ratio = F.col("inliers") / expected
    return lines.join(contour_sizes.select(*keys, "points"), list(keys)).withColumns(
        {
            "confidence": F.when(F.col("inliers") > 0, F.least(F.lit(0.95), ratio)).otherwise(0.3),
            "inlier_ratio": F.col("inliers") / F.greatest(F.lit(1), F.col("points")),
        }
    )


SUB = 1 << 16  # places for the points added after one of a contour


def away_from_edge(points: DataFrame, width: int, height: int, margin: float = FIELD.edge_margin, keys=FRAME) -> DataFrame:
    """The points of each group away from the frame's border; all of them where none is.

    One row per group tells whether it has a point inside, so no group is gathered.
    """
    inside = ~near_edge(width, height, margin)
    groups = points.groupBy(*keys).agg(F.max(inside).alias("some_inside"))
    return salted_join(points, groups, list(keys)).where(inside | ~F.col("some_inside")).drop("some_inside")


def _contour_fit_points(
    contour: pd.DataFrame, width: int, height: int, max_distance: float, min_distance: float, margin: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, x and y that a sorted contour is fitted by: the same as of ``densify_contours`` and ``away_from_edge``."""
    x, y = contour["x"].to_numpy(float), contour["y"].to_numpy(float)
    dx, dy = np.roll(x, -1) - x, np.roll(y, -1) - y
    length = np.sqrt(dx * dx + dy * dy)
    wide = length > max_distance
    extra = np.where(wide, np.ceil(np.where(wide, length, 0.0) / float(max_distance)) - 1, 0).astype(np.int64)
    spacing = length / (extra + 1)
    apart = spacing > 0
    stride = np.where(apart, np.ceil(float(min_distance) / np.where(apart, spacing, 1.0)), 1)
    stride = np.maximum(stride, 1).astype(np.int64)
    at = np.repeat(np.arange(len(x)), extra + 1)
    sub = np.arange(len(at)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
    kept = sub % stride[at] == 0
    at, sub = at[kept], sub[kept]
    part = sub / (extra[at] + 1)
    x, y = x[at] + part * dx[at], y[at] + part * dy[at]
    ids = contour["pt_idx"].to_numpy(np.int64)[at] * SUB + sub
    inside = (x >= margin) & (x <= width - margin) & (y >= margin) & (y <= height - margin)
    if inside.any():
        ids, x, y = ids[inside], x[inside], y[inside]
    return ids, x, y


def extract_field_lines(
    contour_points: DataFrame, width: int, height: int, max_distance: float = FIELD.max_point_distance,
    min_distance: float = FIELD.min_point_distance, margin: float = FIELD.edge_margin,
    num_lines: int = FIELD.num_lines, keys=FRAME, distance: float = FIELD.line_distance,
    trials: int = FIELD.trials, seed: int = 0, min_points: int | None = None,
    min_samples: int = FIELD.min_samples, group_limit: int = 20_000, **fit,
) -> DataFrame:
    """From contours to lines with confidence, for all frames in one plan.

    Takes each frame's largest contour (video_id, frame_idx, contour_id, pt_idx, x, y), fills its long
    edges with points, sets points near the border aside unless that would leave a frame none, fits
    up to ``num_lines`` lines to the rest and rates each by its inliers against the contour's own
    points. ``fit`` goes to ``fit_lines_ransac``. Frames without a contour of the least area have
    no lines.

    The points added are many times the contour's own. Where a frame has no more than ``group_limit``
    of both, they are made where its lines are fitted and never shuffled or written; larger contours
    are filled, sifted and fitted over blocks of points, with the same result.
    """
    keys = list(keys)
    # At most one point is added for each max_distance of an edge.
    dense_size = F.col("points") + F.col("perimeter") / F.lit(float(max_distance))
    best = cut_lineage(
        largest_contour(contour_measures(contour_points), keys=keys)
        .select(*keys, "contour_id", "points", F.coalesce(dense_size > group_limit, F.lit(True)).alias("large"))
    )
    own = salted_join(contour_points, best.drop("points"), [*keys, "contour_id"])
    need = num_lines * min_samples if min_points is None else min_points

    def points_of(contour: pd.DataFrame):
        return _contour_fit_points(contour, width, height, max_distance, min_distance, margin)

    small = own.where(~F.col("large")).select(*keys, "pt_idx", "x", "y")
    lines = _fit_groups(small, keys, ["pt_idx"], points_of, need, (num_lines, distance, trials, seed))
    if not best.where("large").isEmpty():
        dense = densify_contours(own.where("large").drop("large"), max_distance, min_distance)
        kept = away_from_edge(dense, width, height, margin, keys)
        point_id = F.col("pt_idx").cast("bigint") * SUB + F.col("sub_idx")
        # The fit reads its points several times; they are worked out once.
        points = cut_lineage(kept.select(*keys, point_id.alias("point_id"), "x", "y"))
        lines = lines.unionByName(
            fit_lines_ransac(
                points, num_lines, distance, trials, seed, min_samples, min_points, keys, group_limit=group_limit, **fit
            )
        )
    return with_line_band(line_confidence(lines, best, num_lines, keys))


def line_summary(lines: DataFrame, keys=FRAME) -> DataFrame:
    """Per frame: lines, how many are excellent or good, and their mean confidence."""
    c = F.col("confidence")
    return lines.groupBy(*keys).agg(
        F.count("*").alias("lines"),
        F.count(F.when(c > 0.8, 1)).alias("excellent"),
        F.count(F.when((c > 0.6) & (c <= 0.8), 1)).alias("good"),
        F.avg(c).alias("mean_confidence"),
    )


def with_line_band(lines: DataFrame) -> DataFrame:
    return lines.withColumn("band", line_band(F.col("confidence")))
