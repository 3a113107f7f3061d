"""Grouping of spelling variants: words that differ by one inserted, deleted or replaced code point.

Two words are near if their common prefix and common suffix together reach the longer one's length
less one. Blocks of words are compared as dense matrices of code points, one written from the
front and one from the back, padded to one width: both lengths of all pairs of a tile follow from a
few comparisons of whole matrices.

Only blocks that may hold near words meet. The place of the edit lies in one of ``SEGMENTS`` parts of
the longer word, and all outside that part must agree, so words are dealt to buckets by length, part
and what stands outside it. A bucket of more than ``TILE`` words is cut into blocks of about that
many, and every two of its blocks are one tile: no task holds more than two blocks of a bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.support import cut_lineage

RUNS = "[A-Za-z\\u00C0-\\u00FF]{%d,}"
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10  # a form is at least this many times as frequent
SEGMENTS = 4
TILE = 256
ROWS = 20_000  # of the words dealt to one call
MAX_CELLS = 4_000_000  # of the matrices compared at once

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_runs(text: Column, least: int) -> Column:
    """The maximal runs of letters of at least ``least`` code points, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(RUNS % least), F.lit(0))


def misspelt(word: Column, doc: Column) -> Column:
    """The word, or without one code point where 31 divides the crc32 of ``<doc>:<word>``."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    cut = F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))
    return F.when(h % 31 == 0, cut).otherwise(word)


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts with some letters deleted, as often as they occur.

    A null or empty text has no words; a null id counts as an empty one. Repeated rows count each.
    """
    runs = docs.select("doc_id", F.explode(lower_runs(F.col("text"), min_length)).alias("run"))
    words = runs.select(misspelt(F.col("run"), F.col("doc_id")).alias("word"))
    words = words.where(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def buckets(words: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(bucket, word, n): each word under every length, part and rest at which it may have a near word.

    ``bucket`` is a struct of the longer word's length, the part, and the characters before and
    after it. A word may be the longer one, or shorter by one.
    """
    longest = F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)).alias("longest")
    rows = words.select("word", "n", longest)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    edge = lambda k: F.floor(F.col("longest") * k / segments).cast("int")
    front, back = edge(F.col("part")), F.col("longest") - edge(F.col("part") + 1)
    before = F.substr("word", F.lit(1), front)
    after = F.substr("word", F.char_length("word") - back + 1, back)
    return rows.select(F.struct("longest", "part", before.alias("before"), after.alias("after")).alias("bucket"), "word", "n")


def tiles(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(bucket, i, j, block, word, n): the words of each tile; buckets of one word are left out.

    A word of block ``b`` goes to the tiles (i, j), i <= j, that ``b`` is one of.
    """
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("size") / tile).cast("int"))
    dealt = rows.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "word", "n"
    )


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words from the front and from the back, padded with 0, and the lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max(initial=1)) + 1
    kind = np.uint16 if all(w.isascii() or max(w) < "\ud800" for w in words) else np.uint32
    front = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width).astype(kind)
    back = np.array([w[::-1] for w in words], f"<U{width}").view(np.uint32).reshape(len(words), width).astype(kind)
    return front, back, lengths


def _shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many leading places agree, for every pair of rows of each tile. Padding follows the
    shorter word, so distinct words part where it ends at the latest."""
    out = np.zeros((len(left), left.shape[1], right.shape[1]), np.int16)
    same = np.ones(out.shape, bool)
    for k in range(left.shape[2]):
        same &= left[:, :, None, k] == right[:, None, :, k]
        if not same.any():
            break
        out += same
    return out


def near_in_tiles(front, back, lengths, left, right, longest, low, high) -> tuple[np.ndarray, ...]:
    """Tile, row and column of the near pairs of same-sized tiles.

    ``left`` and ``right`` are the words of each tile, as numbers. A pair counts in the bucket of
    its longer word's length and of the first part that its edit may lie in: of places, ``low`` up to
    ``high`` of that bucket.
    """
    prefix, suffix = _shared(front[left], front[right]), _shared(back[left], back[right])
    a, b = lengths[left][:, :, None], lengths[right][:, None, :]
    longer, shorter = np.maximum(a, b), np.minimum(a, b)
    prefix, suffix = np.minimum(prefix, shorter), np.minimum(suffix, shorter)
    first = np.maximum(0, longer - 1 - suffix)
    found = (prefix + suffix >= longer - 1) & (longer - shorter <= 1) & (left[:, :, None] != right[:, None, :])
    found &= (longer == longest[:, None, None]) & (first >= low[:, None, None]) & (first < high[:, None, None])
    return np.nonzero(found)


def compare(rows: pd.DataFrame, segments: int = SEGMENTS) -> pd.DataFrame:
    """Near pairs of whole tiles, each once: word, n, near, near_n, in both directions.

    Tiles of one shape are stacked and compared at once, as many as ``MAX_CELLS`` allows.
    """
    rows = rows.sort_values(["longest", "part", "before", "after", "i", "j", "block"], kind="stable", ignore_index=True)
    names = ["longest", "part", "before", "after", "i", "j"]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[names].to_numpy()[1:] != rows[names].to_numpy()[:-1]).any(1)
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(rows)])
    words = rows.word.tolist()
    front, back, lengths = matrices(words)
    longest, part = rows.longest.to_numpy()[start], rows.part.to_numpy()[start]
    low, high = longest * part // segments, longest * (part + 1) // segments
    split = rows.i.to_numpy()[start] != rows.j.to_numpy()[start]
    in_first = np.add.reduceat(rows.block.to_numpy() == rows.i.to_numpy(), start) if len(rows) else size
    shape = np.stack([np.where(split, in_first, size), np.where(split, size - in_first, size)], 1)
    found = []
    for n, m in np.unique(shape, axis=0):
        if not n or not m:
            continue
        which = np.flatnonzero((shape == (n, m)).all(1))
        step = max(1, MAX_CELLS // int(n * m))
        for k in range(0, len(which), step):
            at = which[k : k + step]
            left = start[at][:, None] + np.arange(n)
            right = start[at][:, None] + np.where(split[at], n, 0)[:, None] + np.arange(m)
            t, x, y = near_in_tiles(front, back, lengths, left, right, longest[at], low[at], high[at])
            a, b = left[t, x], right[t, y]
            once = split[at][t] | (a < b)
            found.append(np.stack([a[once], b[once]], 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    a, b = np.r_[pairs[:, 0], pairs[:, 1]], np.r_[pairs[:, 1], pairs[:, 0]]
    word, n = rows.word.to_numpy(), rows.n.to_numpy()
    return pd.DataFrame({"word": word[a], "n": n[a], "near": word[b], "near_n": n[b]})


def near_words(words: DataFrame, segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """(word, n, near, near_n) for every two near words of ``words`` (word, n), in both directions, once.

    ``words`` are distinct; a null word is near to none. ``segments`` and ``tile`` change the work
    only; a word must be longer than ``segments``.
    """
    rows = cut_lineage(tiles(buckets(words, segments), tile))
    calls = max(1, rows.count() // ROWS)
    flat = rows.select("bucket.*", "i", "j", "block", "word", "n")
    call = F.pmod(F.xxhash64("longest", "part", "before", "after", "i", "j"), F.lit(calls))
    schema = "word string, n long, near string, near_n long"

    def one_call(group: pd.DataFrame) -> pd.DataFrame:
        return compare(group, segments)

    return flat.withColumn("call", call).groupBy("call").applyInPandas(one_call, schema)


def choose_forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` with n_near, form and form_n: the most frequent near word if it is ``ratio`` times as
    frequent, of equal ones the first by code points."""
    best = F.min(F.struct((-F.col("near_n")).alias("down"), F.col("near").alias("near"))).alias("best")
    seen = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    out = words.join(seen, "word", "left")
    fits = -F.col("best.down") >= ratio * F.col("n")
    return out.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.down")).alias("form_n"),
    )


def follow(words: DataFrame) -> DataFrame:
    """``words`` with ``root``, the last word on the way by forms.

    Each step leads to a word ten times as frequent, so ways are short; each round doubles the
    part of the way that is known, and ends when no word moved.
    """
    known = cut_lineage(words.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = cut_lineage(known.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), "beyond"))
        moved = after.where("beyond IS NOT NULL").limit(1).count()
        known = after.drop("beyond")
        if not moved:
            return words.join(known, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of at least ``min_length`` code points that
    occurs ``min_count`` times.

    Null and empty texts have no words, and an empty table gives no rows. Ids serve to delete
    letters only: null ones count as empty, repeated rows count each. Other columns are ignored.
    Ties between forms go to the first word by code points. Texts are never shuffled: words are
    counted in each task before they are.
    """
    words = cut_lineage(count_words(docs, min_length, min_count))
    chosen = cut_lineage(choose_forms(words, near_words(words), ratio))
    return follow(chosen).select("word", "form", "root", "n", "n_near", "form_n")


def oracle(table: str) -> str:
    """DuckDB SQL for ``variants`` over a table: near words meet by what is left of them without one letter."""
    u, lo = _UPPER, _LOWER
    return f"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM (SELECT unnest(range(256)) AS i)
),
runs AS (
    SELECT coalesce(doc_id::varchar, '') || ':' || run AS keyed, run, count(*) AS times
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{u}', '{lo}'), '[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}')) AS run FROM {table})
    GROUP BY ALL
),
-- Of two bytes that a code point up to U+00FF has in UTF-8, the first holds its upper two bits.
hashed AS (
    SELECT run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(keyed) + 1),
               lambda i: CASE WHEN unicode(keyed[i]) < 128 THEN [unicode(keyed[i])::bigint]
                              ELSE [192 + (unicode(keyed[i]) >> 6)::bigint, 128 + (unicode(keyed[i]) & 63)::bigint] END))),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM runs, crc_table
),
words AS (
    SELECT word, sum(times)::bigint AS n
    FROM (SELECT times, CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
    WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(times) >= {MIN_COUNT}
),
shorter AS (SELECT word, n, spot, word[:spot - 1] || word[spot + 1:] AS rest
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS spot FROM words)),
pairs AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.spot = b.spot AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
),
best AS (
    SELECT word, count(*) AS n_near,
           first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n
    FROM pairs GROUP BY word
),
formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
           CASE WHEN b.near_n >= {RATIO} * w.n THEN b.near END AS form, CASE WHEN b.near_n >= {RATIO} * w.n THEN b.near_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word
),
way AS (
    SELECT word, word AS root, 0 AS step FROM formed
    UNION ALL
    SELECT y.word, f.form, y.step + 1 FROM way y JOIN formed f ON f.word = y.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(root, step) AS root FROM way GROUP BY word) r ON r.word = f.word
"""
