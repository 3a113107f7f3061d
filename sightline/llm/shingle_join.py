"""Near duplicates by an exact Jaccard join over word shingles, with token-combination prefixes.

Tokens are hashed shingles in the fixed order of their hashes. Two sets of similarity 0.8 share the
first of their common tokens within their prefixes, and k of them if both prefixes are extended by
k - 1. So a set matters only if enough tokens of its extended prefix stand in other sets too; these
few sets are indexed. Rare tokens are index keys by themselves. A set with enough frequent tokens
may have them alone in common with another and is indexed by combinations: neighbouring tokens in
the order, of which two similar sets always share some of the smallest. Sets with a rare token in
common are counted pair by pair, a few each; those with a combination in common are gathered
around the key's least set, never paired. Each resulting cluster is compared exactly, in tiles of
bounded size, and hands on a spanning forest of its links.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.support import cut_lineage
from .batches import SHARED, Batches, count_shared, local_counts, totals_of
from .components import components
from .words import blocks, lower_ascii, mix

K = 5
PERCENT = 80
EXTEND = 5  # a set's size by this: common tokens asked for in extended prefixes
RARE = 16  # a token in at most so many sets is an index key by itself
TILE = 1500  # sets compared in one task

_NULL = -(1 << 63)


def overlap(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with any similar set, at least."""
    return -(-percent * n // 100)


def wanted(n: int, percent: int) -> int:
    """Common tokens to ask for in the extended prefix of a set of ``n``."""
    return max(1, n // EXTEND)


def prefix(n: int, percent: int) -> int:
    """Length of the extended prefix."""
    return min(n, n - overlap(n, percent) + wanted(n, percent))


@lru_cache(1 << 16)
def combination_keys(n: int, size: int, percent: int) -> int:
    """How many of a set's smallest combinations of ``size`` neighbours hold one that any similar
    set has too; 0 if the guarantee fails.

    A token only here breaks ``size`` of them, one only there ``size - 1``; a and b such tokens
    leave the sets similar while a + b is at most (100 - percent) / percent of what they share.
    """
    loss, a = 0, 0
    while (b := (100 - percent) * (n - a) // percent - a) >= 0 and a <= n:
        loss, a = max(loss, size * a + (size - 1) * b), a + 1
    return loss + 1 if n - size + 1 - loss >= 1 else 0


def shingle_sets(texts: list, k: int = K) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; a text of fewer words has its whole
    sequence as one, one without words (or None) none."""
    out: list[np.ndarray] = []
    for block in blocks(texts):
        block.split()
        hashes = block.word_hashes(lower_ascii(block.data))
        grams, whole = block.grams(hashes, k)
        for a, b in zip(block.word_from, block.word_to):
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64)
                for i in range(a, b):
                    short = mix(short + hashes[i : i + 1])
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(tokens: np.ndarray) -> int:
    """Name of a set, equal for equal sets."""
    size = np.array([len(tokens)], np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return int(mix(tokens.sum(dtype=np.uint64, keepdims=True) + size).view(np.int64)[0])


def combinations(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Combination keys of one set. Small sets have pairs, large ones triples, those between both."""
    keys = [np.zeros(0, np.uint64)]
    for size, least, most in ((2, 2, 10), (3, 6, 1 << 60)):
        if least <= len(tokens) <= most and (n := combination_keys(len(tokens), size, percent)):
            combined = np.full(len(tokens) - size + 1, size, np.uint64)
            for j in range(size):
                combined = mix(combined + tokens[j : len(tokens) - size + 1 + j])
            keys.append(np.sort(combined)[:n])
    return np.unique(np.concatenate(keys))


def links_within(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of side 0 and of side 1 (or all, if one side)."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((m, m), np.float32)
    order = np.lexsort((owner, token))
    owner, first = owner[order], np.cumsum(counts) - counts
    for d in np.unique(counts[(counts > 1) & (counts <= 32)]):  # few sets: add up their pairs
        rows = owner[first[counts == d][:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        for part in np.array_split(rows, -(-rows.size // 200_000)):
            at, n = np.unique((part[:, i] * m + part[:, j]).reshape(-1), return_counts=True)
            common.reshape(-1)[at] += n
    many = np.flatnonzero(counts > 32)
    for part in np.array_split(many, -(-len(many) // 2048)) if len(many) else ():  # many: a matrix product
        has = np.zeros((m, len(part)), np.float32)
        for c, t in enumerate(part):
            has[owner[first[t] : first[t] + counts[t]], c] = 1
        common += np.triu(has @ has.T, 1)
    union = sizes[:, None] + sizes[None, :] - common
    linked = (100 * common.astype(np.float64) >= percent * union.astype(np.float64)) & (common > 0)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    root = np.arange(m)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            forest.append((int(i), int(j)))
    return forest


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the least doc_id reachable by links.

    Two documents link if their sets' intersection is at least ``percent`` (75 to 100) per cent of
    their union. A null or empty text has no set and links with nothing; its component is its own
    id. A null id counts as smaller than any other. Rows that share an id are judged each by its
    text. Copies share one set and are compared once. Other columns are ignored.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent must be from 75 to 100")
    batches = Batches(docs)
    shards = batches.number

    def heads(sets: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([s[: prefix(len(s), percent)] for s in sets] or [np.zeros(0, np.uint64)])

    def distinct(texts: list) -> tuple[list[np.ndarray], np.ndarray, list[int]]:
        sets = shingle_sets(texts, k)
        names = np.array([signature(s) for s in sets], np.int64)
        _, first = np.unique(names, return_index=True)
        return sets, names, [i for i in first if len(sets[i])]

    def count(batch: int, ids, texts: list) -> dict:
        sets, _, first = distinct(texts)
        return local_counts(heads([sets[i] for i in first]), shards, batch)

    def describe(batch: int, ids, texts: list, found) -> dict:
        sets, names, first = distinct(texts)
        keys, totals = totals_of(heads([sets[i] for i in first]), shards, found)
        blobs, marks = [None] * len(sets), [None] * len(sets)
        for i in first:
            n = len(sets[i])
            mine = totals[np.searchsorted(keys, sets[i][: prefix(n, percent)])]
            if (mine > 1).sum() >= wanted(overlap(n, percent), percent):
                blobs[i], marks[i] = sets[i].tobytes(), mine.tobytes()
        return {"doc_id": ids, "n": [len(s) for s in sets], "sig": names, "tokens": blobs, "totals": marks}

    totals = count_shared(batches.each(count, SHARED))
    rows = cut_lineage(batches.each_with(totals, describe, "doc_id long, n int, sig long, tokens binary, totals binary"))
    active = cut_lineage(rows.where("tokens IS NOT NULL").select("sig", "tokens", "totals").dropDuplicates(["sig"]))

    def rare_of(parts):
        for pdf in parts:
            rows = []
            for sig, tokens, marks in zip(pdf["sig"], pdf["tokens"], pdf["totals"]):
                marks, n = np.frombuffer(marks, np.uint8), len(tokens) // 8
                own = np.frombuffer(tokens, np.uint64)[: len(marks)][(marks > 1) & (marks <= RARE)].astype(np.int64)
                rows.append((own, sig, n, int((marks > RARE).sum())))
            if rows:
                sizes = [len(r[0]) for r in rows]
                columns = {c: np.repeat([r[k] for r in rows], sizes) for k, c in ((1, "sig"), (2, "n"), (3, "frequent"))}
                yield pd.DataFrame({"key": np.concatenate([r[0] for r in rows]), **columns})

    def combined_of(parts):
        for pdf in parts:
            sigs, keys = [], []
            for sig, tokens, marks in zip(pdf["sig"], pdf["tokens"], pdf["totals"]):
                if (np.frombuffer(marks, np.uint8) > RARE).sum() >= wanted(overlap(len(tokens) // 8, percent), percent):
                    keys.append(combinations(np.frombuffer(tokens, np.uint64), percent).astype(np.int64))
                    sigs.append(np.full(len(keys[-1]), sig, np.int64))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "sig": np.concatenate(sigs)})

    # A rare token stands in RARE sets at most, so its pairs are few. Of the common tokens that two
    # similar sets have in their extended prefixes, those not rare are frequent in both.
    rare = active.mapInPandas(rare_of, "key long, sig long, n int, frequent int")
    other = rare.select("key", *(F.col(c).alias(f"{c}_b") for c in ("sig", "n", "frequent")))
    ask = F.greatest(F.lit(1), F.floor(F.least("n", "n_b") / EXTEND))
    alike = (F.col("n") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n") * percent)
    pairs = (
        rare.join(other, "key").where((F.col("sig") < F.col("sig_b")) & alike)
        .groupBy("sig", "sig_b").agg(F.count("*").alias("common"), F.first(ask).alias("ask"), F.first(F.least("frequent", "frequent_b")).alias("frequent"))
        .where("common + frequent >= ask").select(F.col("sig").alias("a"), F.col("sig_b").alias("b"))
    )
    index = active.mapInPandas(combined_of, "key long, sig long")
    centre = index.groupBy("key").agg(F.min("sig").alias("centre"), F.max("sig").alias("last")).where("centre <> last")
    stars = index.join(centre.select("key", "centre"), "key").where("sig <> centre").select(F.col("sig").alias("a"), F.col("centre").alias("b")).distinct()
    near = pairs.union(stars)
    clusters = cut_lineage(components(near))
    parts = clusters.groupBy("root").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"))
    placed = clusters.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # A set goes to each tile of its cluster that its part is in.
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.col("node").alias("sig"), "root", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")
    )
    n_tasks = 4 * batches.number
    tiles = tiles.withColumn("task", F.pmod(F.xxhash64("root", "i", "j"), F.lit(n_tasks)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for (_, i, j), group in pdf.groupby(["root", "i", "j"], sort=False):
            sigs = group["sig"].to_numpy()
            forest = links_within([np.frombuffer(t, np.uint64) for t in group["tokens"]], (group["part"] == j).to_numpy() & (i != j), percent)
            a += [sigs[x] for x, _ in forest]
            b += [sigs[y] for _, y in forest]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    links = tiles.join(active.select("sig", "tokens"), "sig").groupBy("task").applyInPandas(compare, "a long, b long")
    linked = components(links)
    named = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first"))
    named = named.join(linked.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "first", F.coalesce("root", "sig").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    component = named.join(least, "root").select("sig", "least")
    found = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(component, "sig", "left")
    plain = lambda c: F.when(c != _NULL, c)
    return found.select(
        plain(F.col("doc_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        plain(F.coalesce("least", "doc_id")).alias("component_id"),
    )
