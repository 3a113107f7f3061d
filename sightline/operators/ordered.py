"""Ordered scans (previous row, carried value, running count) that split long keys.

A plain window puts every row of a key into one task, so one long video would
hold up the job. Here a key's rows are cut into chunks by a column that rises
with the order (such as ``floor(frame_idx / 4096)``): the window runs per
(key, chunk), each chunk leaves one small summary row, and a second window over
the summaries alone carries values across chunk borders. The result does not
depend on the chunk size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 4096
_C = "__chunk"


def chunk_of(name: str, size: int = CHUNK) -> Column:
    return F.floor(F.col(name) / F.lit(size)).cast("bigint")


def _cols(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _order_struct(order) -> Column:
    return F.struct(*_cols(order))


def _start(df: DataFrame, order, chunk: Column | None) -> DataFrame:
    return df.withColumn(_C, chunk if chunk is not None else chunk_of(order[0]))


class Chunks:
    """The pieces for a scan of one's own: windows inside chunks and across their summaries."""

    def __init__(self, df: DataFrame, keys, order, chunk: Column | None = None):
        self.keys = list(keys)
        self.rows = _start(df, order, chunk)
        self.inside = W.partitionBy(*self.keys, _C).orderBy(*_cols(order))
        self.across = W.partitionBy(*self.keys).orderBy(_C)
        self.earlier = self.across.rowsBetween(W.unboundedPreceding, -1)

    def summary(self, rows: DataFrame, *aggs: Column) -> DataFrame:
        """One row per chunk of ``rows``, which derive from ``self.rows``."""
        return rows.groupBy(*self.keys, _C).agg(*aggs)

    def attach(self, rows: DataFrame, summary: DataFrame) -> DataFrame:
        return rows.join(summary, [*self.keys, _C], "left").drop(_C)


def _attach(df: DataFrame, summary: DataFrame, keys) -> DataFrame:
    return df.join(summary, [*keys, _C], "left")


def index_rows(df, keys, order, out="pos", chunk=None) -> DataFrame:
    """Number the rows of each key 0, 1, 2 … in ``order`` (which must be unique)."""
    d = _start(df, order, chunk)
    before = W.partitionBy(*keys).orderBy(_C).rowsBetween(W.unboundedPreceding, -1)
    summary = (
        d.groupBy(*keys, _C)
        .agg(F.count("*").alias("__n"))
        .select(*keys, _C, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    local = F.row_number().over(W.partitionBy(*keys, _C).orderBy(*_cols(order)))
    d = d.withColumn(out, local)
    return (
        _attach(d, summary, keys)
        .withColumn(out, (F.col("__before") + F.col(out) - 1).cast("bigint"))
        .drop("__before", _C)
    )


def neighbour_rows(df, keys, order, cols, prefix, step=-1, wrap=False, chunk=None) -> DataFrame:
    """Add ``prefix + col`` from the previous (-1) or next (+1) row of the key.

    With ``wrap`` the last row's next is the first row, as on a closed polygon.
    """
    d = _start(df, order, chunk)
    value = F.struct(*_cols(cols))
    inside = W.partitionBy(*keys, _C).orderBy(*_cols(order))
    across = W.partitionBy(*keys).orderBy(_C)
    if step < 0:
        edge, near, far = F.max_by, F.lag(value).over(inside), F.lag("__edge").over(across)
        end = F.last("__edge")
    else:
        edge, near, far = F.min_by, F.lead(value).over(inside), F.lead("__edge").over(across)
        end = F.first("__edge")
    summary = d.groupBy(*keys, _C).agg(edge(value, _order_struct(order)).alias("__edge"))
    if wrap:
        whole = across.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        far = F.coalesce(far, end.over(whole))
    summary = summary.select(*keys, _C, far.alias("__far"))
    d = _attach(d.withColumn("__near", near), summary, keys)
    found = F.coalesce("__near", "__far")
    return d.withColumns({f"{prefix}{c}": found[c] for c in cols}).drop("__near", "__far", _C)


def carry_forward(df, keys, order, cols, prefix="last_", chunk=None) -> DataFrame:
    """Add ``prefix + col``: the newest non-null value of ``col`` up to and with this row."""
    d = _start(df, order, chunk)
    upto = W.partitionBy(*keys, _C).orderBy(*_cols(order)).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(_C).rowsBetween(W.unboundedPreceding, -1)
    at = _order_struct(order)
    summary = d.groupBy(*keys, _C).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"__s_{c}") for c in cols]
    ).select(
        *keys, _C,
        *[F.last(f"__s_{c}", ignorenulls=True).over(before).alias(f"__b_{c}") for c in cols],
    )
    d = d.withColumns({f"{prefix}{c}": F.last(c, ignorenulls=True).over(upto) for c in cols})
    d = _attach(d, summary, keys)
    return d.withColumns(
        {f"{prefix}{c}": F.coalesce(f"{prefix}{c}", f"__b_{c}") for c in cols}
    ).drop(_C, *[f"__b_{c}" for c in cols])


def running_sum(df, keys, order, col, out, chunk=None) -> DataFrame:
    """Sum of ``col`` over the key's rows up to and with this row."""
    d = _start(df, order, chunk)
    upto = W.partitionBy(*keys, _C).orderBy(*_cols(order)).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(_C).rowsBetween(W.unboundedPreceding, -1)
    summary = (
        d.groupBy(*keys, _C)
        .agg(F.sum(col).alias("__s"))
        .select(*keys, _C, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    )
    d = _attach(d.withColumn(out, F.sum(col).over(upto)), summary, keys)
    return d.withColumn(out, F.col("__before") + F.col(out)).drop("__before", _C)


def running_max(df, keys, order, col, out, chunk=None) -> DataFrame:
    """Largest ``col`` over the key's rows up to and with this row."""
    d = _start(df, order, chunk)
    upto = W.partitionBy(*keys, _C).orderBy(*_cols(order)).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(_C).rowsBetween(W.unboundedPreceding, -1)
    summary = (
        d.groupBy(*keys, _C)
        .agg(F.max(col).alias("__m"))
        .select(*keys, _C, F.max("__m").over(before).alias("__before"))
    )
    d = _attach(d.withColumn(out, F.max(col).over(upto)), summary, keys)
    return d.withColumn(out, F.greatest(out, "__before")).drop("__before", _C)


def rolling(df, keys, order, n, aggs: dict[str, Column], chunk=None, block=CHUNK) -> DataFrame:
    """Aggregates over each row and the ``n - 1`` rows before it in the key.

    Rows are numbered first, then cut into blocks of exactly ``block`` rows; the
    last ``n - 1`` rows of a block are copied into the next one as its run-up.
    """
    if n - 1 > block:
        raise ValueError("the window must fit in one block")
    d = index_rows(df, keys, order, "__pos", chunk)
    home = F.floor(F.col("__pos") / F.lit(block)).cast("bigint")
    tail = F.col("__pos") % F.lit(block) >= F.lit(block - (n - 1))
    d = d.withColumn("__own", home).withColumn(
        "__block",
        F.explode(F.when(tail, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))),
    )
    w = W.partitionBy(*keys, "__block").orderBy("__pos").rowsBetween(-(n - 1), 0)
    d = d.withColumns({name: agg.over(w) for name, agg in aggs.items()})
    return d.filter(F.col("__block") == F.col("__own")).drop("__pos", "__own", "__block")


def newest(df, keys, order, n, out="age") -> DataFrame:
    """The newest ``n`` rows of each key, numbered 1 (newest) … n.

    The bound on the row number lets Spark drop all but ``n`` rows per key in
    each task before the shuffle, so a long key moves little data.
    """
    w = W.partitionBy(*keys).orderBy(*[c.desc() for c in _cols(order)])
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)
