"""Site boilerplate: lines that stand on too large a share of a host's pages are dropped.

DataFrame functions only. A line is counted by a 128-bit hash, so the counting shuffle carries 16
bytes for each distinct line of a page, combined in each task first; texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh

RATIO = 0.1
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host: str = "source", text: str = "text") -> DataFrame:
    """(host, keys): hashes of the lines on more than ``ratio`` of the host's pages, at least ``min_pages``.

    The shares of a host's lines add up to its pages' mean number of distinct lines, so ``keys``
    has fewer than that mean divided by ``ratio`` entries, however many pages there are.
    """
    pages = docs.groupBy(F.col(host).alias("__host")).agg(F.count("*").alias("__pages"))
    lines = docs.select(
        F.col(host).alias("__host"),
        F.explode(F.array_distinct(F.filter(_lines(F.col(text)), lambda x: F.trim(x) != ""))).alias("__line"),
    )
    counts = lines.select("__host", _key(F.col("__line")).alias("__key")).groupBy("__host", "__key").agg(F.count("*").alias("__on"))
    # No line on fewer pages can qualify, so the few others alone meet the totals.
    frequent = counts.where(F.col("__on") >= min_pages).withColumnRenamed("__host", "__of")
    return (
        frequent.join(pages, F.col("__of").eqNullSafe(F.col("__host")))
        .where(F.col("__on") > F.lit(ratio) * F.col("__pages"))
        .groupBy("__host")
        .agg(F.collect_list("__key").alias("__keys"))
    )


def drop_boilerplate(
    docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host: str = "source", text: str = "text",
    counts: bool = False,
) -> DataFrame:
    """``docs`` with the boilerplate lines cut out of ``text``; all rows and columns stay.

    Every row is a page of its ``host``; rows with a null host form one host, and repeated rows
    are pages of their own. A page counts once for each of its distinct lines. Empty lines and
    lines of spaces only are never dropped or counted. A null text has no lines and stays null; a text all of whose lines
    are boilerplate becomes empty. ``counts`` adds ``n_lines`` and ``n_dropped``, in place of
    columns so named.
    """
    columns = docs.columns
    of, keys, split, kept_lines = fresh(columns, "__host", "__keys", "__lines", "__kept")
    found = boilerplate(docs, ratio, min_pages, host, text).withColumnsRenamed({"__host": of, "__keys": keys})
    # The list is small: adaptive execution broadcasts it if its measured size allows, else joins
    # by shuffle and splits a large host.
    joined = docs.join(found, docs[host].eqNullSafe(found[of]), "left")
    lines = _lines(F.col(text))
    kept = F.when(
        F.col(keys).isNull(), lines
    ).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(keys), _key(x))))
    joined = joined.withColumns({split: lines, kept_lines: kept})
    out = {text: F.when(F.col(text).isNotNull(), F.array_join(kept_lines, "\n"))}
    if counts:
        n = F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long")
        out |= {"n_lines": n, "n_dropped": (F.size(split) - F.size(kept_lines)).cast("long")}
    return joined.withColumns(out).select(*dict.fromkeys([*columns, *(out if counts else ())]))


def oracle(table: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """The same result in SQL over ``table`` (doc_id, text, source), with counts."""
    return f"""
WITH base AS (SELECT row_number() OVER () AS rid, * FROM {table}),
pages AS (SELECT source, count(*) AS pages FROM base GROUP BY source),
lines AS (
  SELECT rid, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM base WHERE text IS NOT NULL),
counts AS (SELECT source, line, count(DISTINCT rid) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY source, line),
bad AS (
  SELECT c.source, c.line FROM counts c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source
  WHERE c.n >= {min_pages} AND c.n > CAST({ratio} AS DOUBLE) * p.pages),
kept AS (
  SELECT l.rid, count(*) AS n_lines, count(*) FILTER (WHERE b.line IS NOT NULL) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE b.line IS NULL), '') AS text
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line GROUP BY l.rid)
SELECT b.doc_id, b.source, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, k.text AS text
FROM base b LEFT JOIN kept k USING (rid)"""
