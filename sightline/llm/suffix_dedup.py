"""Exact removal of repeated byte strings through a family of sparse suffix arrays.

A string of ``length`` bytes is looked up at one of its suffixes only: every window of that length
has an anchor, the least hash of the short strings inside it, and equal windows have equal anchors.
Neighbouring windows with one anchor form a segment. Anchors are counted first; only segments whose
anchor stands in several documents are indexed, in shards by anchor. There each batch of segments
gets its suffix array: the windows ordered by a 64-bit fingerprint of their bytes (order serves
equality only), each with the least document that holds it. Arrays form levels: two of about one
size are merged, so a window is moved log(batches) times, and a batch is scanned against the few
levels that stand. What a batch holds once or a thousand times is sent and answered once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import SHARED, Batches, count_shared, deal, local_counts, totals_of
from .words import Block, blocks, prefix_sums, slice_hashes

LENGTH = 50
ANCHOR = 20

_NULL = -(1 << 63)
SPANS = "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"


class Levels:
    """Suffix arrays of growing size: sorted distinct keys, each with its least document."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # largest first

    def add(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """A batch's suffix array becomes a level; while the last two are of one size class, they merge.

        Returns the order of the batch's keys.
        """
        order = np.argsort(keys)
        keys, docs = keys[order], docs[order]
        if len(keys):
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, docs = keys[first], np.minimum.reduceat(docs, first)
        self.levels.append((keys, docs))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            last, before = self.levels.pop(), self.levels.pop()
            self.levels.append(self.merge(*sorted([before, last], key=lambda level: -len(level[0]))))
        return order

    @staticmethod
    def merge(larger: tuple[np.ndarray, np.ndarray], smaller: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """One level of two: keys of both take the lesser document, new ones go where they belong."""
        (keys, docs), (more, theirs) = larger, smaller
        at = np.searchsorted(keys, more)
        known = at < len(keys)
        known[known] = keys[at[known]] == more[known]
        docs[at[known]] = np.minimum(docs[at[known]], theirs[known])
        place = at[~known] + np.arange(len(more) - np.count_nonzero(known))
        old = np.ones(len(keys) + len(place), bool)
        old[place] = False
        out = np.empty(len(old), keys.dtype), np.empty(len(old), docs.dtype)
        for column, own, new in zip(out, (keys, docs), (more, theirs)):
            column[old], column[place] = own, new[~known]
        return out

    def least(self, keys: np.ndarray) -> np.ndarray:
        """The least document that holds each of the sorted keys, over all levels."""
        out = np.full(len(keys), np.iinfo(np.int64).max)
        for known, docs in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                np.minimum(out, docs[at], out=out, where=known[at] == keys)
        return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(block: Block, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, end of windows, anchor's hash) of each segment of a block."""
    data = block.data
    none = np.zeros(0, np.int64)
    if len(data) <= length:
        return none, none, none, np.zeros(0, np.uint64)
    at = np.arange(len(data) - anchor + 1)
    least = _sliding_min(slice_hashes(prefix_sums(data), at, at + anchor), length - anchor + 1)
    # Windows that reach over a text's end belong to none.
    step = np.zeros(len(least) + 1, np.int64)
    starts, ends = block.doc_starts, np.maximum(block.doc_ends - length, block.doc_starts)
    np.add.at(step, np.minimum(starts, len(least)), 1)
    np.add.at(step, np.minimum(ends, len(least)), -1)
    valid = np.cumsum(step[:-1]) > 0
    change = np.r_[True, (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])]
    change[starts[starts < len(least)]] = True
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(least)]
    ok = valid[first]
    first, last = first[ok], last[ok]
    return np.searchsorted(block.doc_ends, first, "right"), first, last, least[first]


def _segments_of(texts: list, length: int, anchor: int):
    """Blocks of the texts with their segments; documents counted within the batch."""
    for block in blocks(texts):
        doc, first, last, key = segments(block, length, anchor)
        yield block, doc + block.first, first, last, key


SENT = "shard int, batch int, sizes binary, text binary, least binary, greatest binary"
ANSWERS = "shard int, batch int, string binary, start binary, end binary, least binary"


class _Strings:
    """The distinct segment strings of a batch that go to one shard."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.least: list[int] = []
        self.greatest: list[int] = []

    def add(self, string: bytes, doc: int) -> int:
        n = self.number.setdefault(string, len(self.least))
        if n == len(self.least):
            self.least.append(doc)
            self.greatest.append(doc)
        else:
            self.least[n], self.greatest[n] = min(self.least[n], doc), max(self.greatest[n], doc)
        return n


def _gather(doc_ids, parts: list, length: int, keys: np.ndarray, shards: int, each=None) -> dict[int, _Strings]:
    """Strings of the segments whose anchor is among the sorted ``keys``; ``each(shard, number, document, place)`` hears of all."""
    found: dict[int, _Strings] = {}
    ids = [int(d) for d in doc_ids]
    for block, doc, first, last, key in parts:
        shared = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key) if len(keys) else key[:0].astype(int)
        raw = block.data.tobytes()
        shard = np.zeros(len(shared), np.int64)
        for s, at in enumerate(deal(key[shared], shards)):
            shard[at] = s
        starts = block.doc_starts[doc[shared] - block.first]
        for s, d, a, b, begin in zip(shard.tolist(), doc[shared].tolist(), first[shared].tolist(), last[shared].tolist(), starts.tolist()):
            own = found.get(s)
            if own is None:
                own = found[s] = _Strings()
            n = own.add(raw[a : b + length - 1], ids[d])
            if each:
                each(s, n, d, a - begin)
    return found


def _answer(pdf, length: int) -> dict:
    """One shard: index every batch's windows, then scan every batch against the levels."""
    levels, held = Levels(), []
    for row in pdf.itertuples():
        sizes, data = np.frombuffer(row.sizes, np.int64), np.frombuffer(row.text, np.uint8)
        string, offset = _windows(sizes, length)
        at = (np.cumsum(sizes) - sizes)[string] + offset
        keys = np.concatenate([slice_hashes(s, x - base, x - base + length) for s, x, base in _pieces(data, at, length)] or [np.zeros(0, np.uint64)])
        order = levels.add(keys, np.frombuffer(row.least, np.int64)[string])
        held.append((row.shard, row.batch, keys[order], order, sizes, np.frombuffer(row.greatest, np.int64)))
    out: dict = {c.split()[0]: [] for c in ANSWERS.split(", ")}
    for shard, batch, keys, order, sizes, greatest in held:
        string, offset = _windows(sizes, length)
        least = np.empty(len(keys), np.int64)
        least[order] = levels.least(keys)
        use = np.flatnonzero(least < greatest[string])
        if not len(use):
            continue
        s, o, m = string[use], offset[use], least[use]
        begin = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1) | (m[1:] != m[:-1])])
        end = np.r_[begin[1:], len(use)] - 1
        for name, value in zip(out, (shard, batch, s[begin].tobytes(), o[begin].tobytes(), (o[end] + 1).tobytes(), m[begin].tobytes())):
            out[name].append(value)
    return out


def _windows(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of every window of strings of these sizes."""
    counts = sizes - length + 1
    string = np.repeat(np.arange(len(sizes)), counts)
    return string, np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)


def _pieces(data: np.ndarray, at: np.ndarray, length: int, size: int = 1 << 20):
    """Prefix sums over parts of ``data`` that hold the windows at ``at`` (in order)."""
    i = 0
    while i < len(at):
        base = int(at[i])
        j = int(np.searchsorted(at, base + size))
        yield prefix_sums(data[base : int(at[j - 1]) + length]), at[i:j], base
        i = j


def union(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the intervals; touching ones join."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Per row: doc_id, n_bytes, ``spans`` removed (byte offsets) and the bytes ``kept``.

    A byte is removed if it lies in a string of ``length`` bytes that also starts in a document with
    a smaller doc_id, as the documents were given. A null text counts as empty; a null id is smaller
    than any other. Rows with one id never remove from each other. Other columns are ignored.
    """
    batches = Batches(docs)
    shards = batches.number

    def count(batch: int, ids, texts: list) -> dict:
        pairs = []
        for _, doc, _, _, key in _segments_of(texts, length, anchor):
            order = np.lexsort((doc, key))
            k, d = key[order], doc[order]
            pairs.append(k[np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]] if len(k) else k)
        return local_counts(np.concatenate(pairs), shards, batch)

    def shared_keys(texts: list, found):
        """The batch's segments, worked out once for all that is asked of them, and their shared keys."""
        parts = list(_segments_of(texts, length, anchor))
        keys, totals = totals_of(np.concatenate([key for *_, key in parts]), shards, found)
        return parts, keys[totals > 1]

    def send(batch: int, ids, texts: list, found) -> dict:
        parts, keys = shared_keys(texts, found)
        strings = _gather(ids, parts, length, keys, shards)
        return {
            "shard": list(strings), "batch": [batch] * len(strings),
            "sizes": [np.array([len(t) for t in s.number], np.int64).tobytes() for s in strings.values()],
            "text": [b"".join(s.number) for s in strings.values()],
            "least": [np.array(s.least, np.int64).tobytes() for s in strings.values()],
            "greatest": [np.array(s.greatest, np.int64).tobytes() for s in strings.values()],
        }

    def answer(pdf):
        import pandas as pd

        return pd.DataFrame(_answer(pdf, length))

    def cut(batch: int, ids, texts: list, found) -> dict:
        known = found[found["totals"].notna()]
        segs, keys = shared_keys(texts, known)
        answers: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for row in found[found["string"].notna()].itertuples():
            parts = [np.frombuffer(getattr(row, c), np.int64).tolist() for c in ("string", "start", "end", "least")]
            for n, a, b, least in zip(*parts):
                answers.setdefault((row.shard, n), []).append((a, b, least))
        removed: list[list[tuple[int, int]]] = [[] for _ in texts]
        own = [int(d) for d in ids]

        def hear(shard: int, n: int, d: int, place: int) -> None:
            for a, b, least in answers.get((shard, n), ()):
                if least < own[d]:
                    removed[d].append((place + a, place + b + length - 1))

        _gather(ids, segs, length, keys, shards, hear)
        spans, kept, sizes = [], [], []
        for text, runs in zip(texts, removed):
            blob, runs = text.encode("utf-8", "surrogatepass"), union(runs)
            edges = [0, *(x for run in runs for x in run), len(blob)]
            kept.append(b"".join(blob[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append([{"start": a, "end": b} for a, b in runs])
            sizes.append(len(blob))
        return {"doc_id": ids, "n_bytes": sizes, "spans": spans, "kept": kept}

    totals = count_shared(batches.each(count, SHARED))
    answers = batches.each_with(totals, send, SENT).groupBy("shard").applyInPandas(answer, ANSWERS)
    found = totals.unionByName(answers, allowMissingColumns=True)
    out = batches.each_with(found, cut, SPANS)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _NULL, F.col("doc_id")))
