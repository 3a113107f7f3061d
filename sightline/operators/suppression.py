"""Box-against-box work inside a frame: overlap pairs and non-maximum suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import boxes
from ..settings import DETECTION
from .detections import by_model
from .support import cut_lineage

GROUP = ("video_id", "frame_idx", "model_type")
CELL = 128
FRAMES = 64  # frames that look up their next ones in one task


def _in_cells(df: DataFrame, cell: int) -> DataFrame:
    """One row per grid cell that a box touches."""
    def cells(low, high):
        return F.sequence(
            F.floor(F.col(low) / F.lit(cell)).cast("int"),
            F.floor(F.col(high) / F.lit(cell)).cast("int"),
        )

    return df.withColumn("cell_x", F.explode(cells("x1", "x2"))).withColumn(
        "cell_y", F.explode(cells("y1", "y2"))
    )


def _home_cell(a: boxes.Box, b: boxes.Box, cell: int) -> Column:
    """True in the one cell that holds the top-left corner of the intersection."""
    return (
        F.floor(F.greatest(a[0], b[0]) / F.lit(cell)) == F.col("a.cell_x")
    ) & (F.floor(F.greatest(a[1], b[1]) / F.lit(cell)) == F.col("a.cell_y"))


def iou_pairs(
    df: DataFrame, threshold: float, keys=GROUP, order: str = "det_idx", cell: int = CELL
) -> DataFrame:
    """Pairs of boxes of one group with IoU above ``threshold``, each pair once.

    Boxes meet only in shared grid cells, so a crowded frame is compared cell by
    cell and spreads over tasks instead of forming all its pairs.
    """
    d = _in_cells(df.select(*keys, order, "x1", "y1", "x2", "y2"), cell)
    a, b = boxes.box("a"), boxes.box("b")
    join = F.lit(True)
    for k in (*keys, "cell_x", "cell_y"):
        join = join & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    join = (
        join
        & (F.col(f"a.{order}") < F.col(f"b.{order}"))
        & _home_cell(a, b, cell)
        & boxes.overlaps_more_than(a, b, threshold)
    )
    return d.alias("a").join(d.alias("b"), join).select(
        *[F.col(f"a.{k}") for k in keys],
        F.col(f"a.{order}").alias(f"{order}_a"),
        F.col(f"b.{order}").alias(f"{order}_b"),
        boxes.iou(a, b).alias("iou"),
    )


def _greedy(sorted_boxes: Column, threshold: float, most: Column | None) -> Column:
    """Fold boxes in score order, keeping each that no kept box overlaps too much.

    Once ``most`` boxes are kept no later one can enter the result.
    """
    empty = F.filter(sorted_boxes, lambda _: F.lit(False))

    def step(kept, candidate):
        # Functions on arrays are not compiled: the few pairs that meet at all pay for the areas.
        def clashes(k):
            a, b = boxes.fields(k), boxes.fields(candidate)
            return boxes.may_overlap(a, b) & boxes.overlaps_more_than(a, b, threshold)

        clash = F.exists(kept, clashes)
        done = clash if most is None else (F.size(kept) >= most) | clash
        return F.when(done, kept).otherwise(F.concat(kept, F.array(candidate)))

    return F.aggregate(sorted_boxes, empty, step)


def nms(
    df: DataFrame,
    iou: float = DETECTION.nms_iou,
    max_det: dict | None = None,
    keys=GROUP,
    fold_limit: int = 1024,
) -> DataFrame:
    """Greedy non-maximum suppression per group, then at most ``max_det`` boxes per model, if given.

    Score order is confidence down (null last), then ``det_idx``. Groups up to ``fold_limit``
    boxes are folded in place; larger ones are settled by rounds over their
    overlap pairs, with the same result. A box without a finite area (flat, or with a null or
    endless coordinate) overlaps none: it is kept and drops no other.
    """
    keys = list(keys)
    over = (
        df.groupBy(*keys).count().filter(F.col("count") > fold_limit).select(*keys)
    )
    kept = _nms_fold(df, iou, keys, fold_limit, max_det)
    if not over.isEmpty():
        kept = kept.unionByName(_nms_rounds(df.join(over, keys, "left_semi"), iou, keys))
    if max_det is None:
        return kept
    score = W.partitionBy(*keys).orderBy(_score(), "det_idx")
    top = max(max_det.values())
    return (
        kept.withColumn("__rank", F.row_number().over(score))
        .filter(F.col("__rank") <= top)
        .filter(F.col("__rank") <= by_model(max_det, top))
        .drop("__rank")
    )


def _score() -> Column:
    """Ascending in score order; a null confidence comes last."""
    return F.coalesce(-F.col("confidence").cast("double"), F.lit(float("inf")))


def _nms_fold(
    df: DataFrame, iou: float, keys: list[str], limit: int, max_det: dict | None
) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    record = F.struct(
        _score().alias("__score"), F.col("det_idx"), *[c for c in rest if c != "det_idx"]
    )
    # The row bound keeps an oversize group from being gathered at all: it goes to the rounds.
    w = W.partitionBy(*keys).orderBy(_score(), "det_idx")
    few = df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= limit + 1)
    grouped = (
        few.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(record)).alias("__boxes"))
        .filter(F.size("__boxes") <= limit)
    )
    most = None if max_det is None else by_model(max_det, max(max_det.values()))
    out = grouped.select(*keys, F.inline(_greedy(F.col("__boxes"), iou, most)))
    return out.select(*df.columns)


def _nms_rounds(df: DataFrame, iou: float, keys: list[str]) -> DataFrame:
    """Suppression over overlap pairs: each round keeps every box no open better box overlaps."""
    if iou >= 1:
        return df  # an overlap is never above the whole
    score = F.struct(_score().alias("s"), F.col("det_idx").alias("d"))
    finite = boxes.area(boxes.box()).cast("double") < F.lit(float("inf"))  # false if not a number
    geometry = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & finite
    geometry = F.coalesce(geometry, F.lit(False))
    # Below 1 equal boxes suppress each other, so only the best of each survives to the pairs.
    flat = df.filter(~geometry)
    unique = (
        df.filter(geometry)
        .groupBy(*keys, "x1", "y1", "x2", "y2")
        .agg(F.min(score).alias("__score"))
        .withColumn("det_idx", F.col("__score.d"))
    )
    unique = cut_lineage(unique)
    pairs = iou_pairs(unique, iou, keys)
    rank = unique.select(*keys, F.col("det_idx"), F.col("__score").alias("s"))
    pairs = pairs.join(
        rank.withColumnsRenamed({"det_idx": "det_idx_a", "s": "sa"}), [*keys, "det_idx_a"]
    ).join(rank.withColumnsRenamed({"det_idx": "det_idx_b", "s": "sb"}), [*keys, "det_idx_b"])
    better = F.col("sa") < F.col("sb")
    edges = cut_lineage(
        pairs.select(
            *keys,
            F.when(better, F.col("det_idx_a")).otherwise(F.col("det_idx_b")).alias("winner"),
            F.when(better, F.col("det_idx_b")).otherwise(F.col("det_idx_a")).alias("loser"),
        )
    )
    dropped = None
    while not edges.isEmpty():
        losers = edges.select(*keys, F.col("loser").alias("winner")).distinct()
        free = edges.select(*keys, "winner").distinct().join(
            losers, [*keys, "winner"], "left_anti"
        )
        out = edges.join(free, [*keys, "winner"], "left_semi").select(
            *keys, F.col("loser").alias("det_idx")
        ).distinct()
        out = cut_lineage(out)
        dropped = out if dropped is None else dropped.unionByName(out)
        gone = out.withColumnRenamed("det_idx", "gone")
        edges = edges.join(
            gone.withColumnRenamed("gone", "winner"), [*keys, "winner"], "left_anti"
        ).join(gone.withColumnRenamed("gone", "loser"), [*keys, "loser"], "left_anti")
        edges = cut_lineage(edges)
    survivors = unique.select(*keys, "det_idx")
    if dropped is not None:
        survivors = survivors.join(dropped, [*keys, "det_idx"], "left_anti")
    return df.join(survivors.unionByName(flat.select(*keys, "det_idx")),
                   [*keys, "det_idx"], "left_semi")


def link_candidates(
    df: DataFrame, threshold: float = 0.3, keys=("video_id", "model_type"), cell: int = CELL
) -> DataFrame:
    """Boxes of frame t and t+1 that are each other's best overlap above ``threshold``.

    Boxes meet only in shared grid cells. A cell's boxes go once, by blocks of frames, to the task that
    looks up those of the next frame; only a block's first frame goes to the block before it as well.
    """
    keys = list(keys)
    base = df.select(*keys, "frame_idx", "det_idx", "x1", "y1", "x2", "y2").dropna(subset=[*keys, "frame_idx"])
    block = F.floor(F.col("frame_idx") / FRAMES)
    first = F.pmod("frame_idx", F.lit(FRAMES)) == 0
    blocks = F.when(first, F.array(block, block - 1)).otherwise(F.array(block))
    here = _in_cells(base.withColumn("__block", F.explode(blocks)), cell)
    next_frame = W.partitionBy(*keys, "__block", "cell_x", "cell_y").orderBy("frame_idx").rangeBetween(1, 1)
    record = ("det_idx", "x1", "y1", "x2", "y2")
    met = here.withColumn("__next", F.collect_list(F.struct(*record)).over(next_frame)).select(
        *keys, "frame_idx", F.struct(*record, "cell_x", "cell_y").alias("a"), F.explode("__next").alias("b")
    )
    a, b = boxes.box("a"), boxes.box("b")
    pairs = met.where(_home_cell(a, b, cell) & boxes.overlaps_more_than(a, b, threshold)).select(
        *keys, "frame_idx", F.col("a.det_idx").alias("det_idx"), F.col("b.det_idx").alias("next_det_idx"),
        boxes.iou(a, b).alias("iou"),
    )
    return mutual_best(pairs, [*keys, "frame_idx"], "det_idx", "next_det_idx", "iou")


def mutual_best(pairs: DataFrame, keys, left: str, right: str, score: str) -> DataFrame:
    """Keep pairs whose ends each rank the other first (ties to the lower id)."""
    # Both ranks are taken over one pass of the pairs, whose join is the dear part.
    ranks = {
        f"__of_{end}": F.row_number().over(W.partitionBy(*keys, end).orderBy(F.col(score).desc(), other))
        for end, other in ((left, right), (right, left))
    }
    first = F.lit(True)
    for name in ranks:
        first = first & (F.col(name) == 1)
    return pairs.withColumns(ranks).where(first).select(*keys, left, right, score)
