"""Benchmark passages in documents, edited ones too: CGK embedding, bit sampling, exact verification.

The CGK walk reads a window character by character under a fixed random string and repeats a
character or moves on by it, which turns few edits into few differing positions. Windows are sized
by the shortest item. An item has one from each of its words, a document from every
``STRIDE``-th word or closer, so that a passage holds a window that begins as one of the item
does, wherever it stands: an unedited passage is always found. Windows that agree at some sample of
embedded positions become candidates, and the passage around each is compared with the whole
item by edit distance.

Recall: two windows whose embeddings differ at a share h of the positions agree in one sample with
probability (1 - h) ** SAMPLED, and a passage has windows x WALKS x SAMPLES tries. That finds
lightly edited passages; many edits spoil every window. So an item is also asked for over its whole
length: seeds, runs of a few bytes from each of its places, are looked up in the document, and
those that agree on where the item would begin, give or take the edits allowed, are counted; then
shorter seeds are, around what is left. How many must agree is what ``recall`` of the passages with
the most edits allowed still share in trials with random edits, half of the loss for each count.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrow import slices
from .words import Block, blocks

STRIDE = 8  # words between windows of a document at most
LONGEST = 32  # characters of a window at most
WINDOW_SHARE = 0.4  # of the shortest item that a window takes
SHORTEST = 16  # items under this length are looked up as they are
WALKS = 2
SAMPLES = 6
SAMPLED = 10
MAX_EDITS = 0.2  # share of an item's length
SAME = 0.5  # share of equal embedded positions that a candidate needs
RECALL = 0.98  # of passages with as many random edits as allowed that must become candidates by seeds
SEEDS = (7, 6, 5, 4, 3)  # bytes of a seed, cheapest first
FINE = 5  # bytes of the seeds that candidates are looked at by again
AGREE = 4  # seeds that must agree, at least; else the next of SEEDS is taken
TRIALS = 400
SLICE = 1 << 19  # bytes of a block whose seeds are counted at a time
LANES = 1 << 13  # pieces of items whose edits are worked out side by side
CANDIDATES = 1 << 12  # looked at together; a few are compared one by one
FEW = 16
SLOTS = 20  # bits of a seed's slot, and of a counter's
ITEMS = 1000  # items sent to the tasks at a time
SEED = 5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def fold(text: str | None) -> bytes:
    """Letters A-Z in lower case and every white-space byte a space: what passages are compared by."""
    return _FOLD[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)].tobytes()


class Walk:
    """One CGK embedding of windows of ``width`` characters, and its samples of positions."""

    def __init__(self, width: int, number: int):
        rng = np.random.default_rng([SEED, width, number])
        self.width, self.steps = width, 2 * width
        self.moves = rng.integers(0, 2, (self.steps, 256), dtype=np.uint8)
        self.samples = [np.sort(rng.choice(self.steps, SAMPLED, replace=False)) for _ in range(SAMPLES)]

    def embed(self, data: np.ndarray, starts: np.ndarray, only=None) -> np.ndarray:
        """(steps, windows) characters of the walk; past a window's end there is a null."""
        at = starts.astype(np.int64)
        ends = at + self.width
        last = len(data) - 1
        out = np.zeros((self.steps if only is None else len(only), len(starts)), np.uint8)
        row = 0
        for step in range(self.steps if only is None else only[-1] + 1):
            seen = data[np.minimum(at, last)]
            seen[at >= ends] = 0
            if only is None or step == only[row]:
                out[row] = seen
                row += 1
            at += self.moves[step][seen]
        return out

    def keys(self, data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """The sampled characters of each window as one number, for each sample."""
        steps = np.unique(np.concatenate(self.samples))
        rows = self.embed(data, starts, steps)
        out = []
        for sample in self.samples:
            key = np.zeros(len(starts), np.uint64)
            for r in np.searchsorted(steps, sample):
                key = key * np.uint64(0x9E3779B97F4A7C15) + rows[r]
            out.append(key)
        return out


def edit_distance(item: bytes, text: bytes, most: int) -> tuple[int, int]:
    """Least edits from ``item`` to a part of ``text``, and where that part ends; (most + 1, 0) if more.

    Bit-parallel: a column of the distance table is two whole numbers of differences.
    """
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score = full, 0, len(item)
    best, end = min(most + 1, len(item)), 0  # the empty part
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (~(across | plus) & full), plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full  # a part may begin anywhere: no edit above
        either = eq | minus
        plus, minus = down | (~(either | up) & full), up & either
        if score < best:
            best, end = score, j
    return best, end


def least_edits(items: list[bytes], data: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Edits that lead at least from ``items[owner]`` to any part of ``data[low:high]``, for many spans at once.

    An item is cut into pieces of up to 64 bytes. Those of a passage lie apart, so that its edits
    are no fewer than the pieces' own at their best places, which are worked out side by side.
    """
    cuts = [np.array_split(np.frombuffer(f, np.uint8), -(-len(f) // 64)) for f in items]
    sizes = np.array([len(c) for c in cuts])
    cut = [c for own in cuts for c in own]
    length = np.array([len(c) for c in cut])
    out = np.zeros(len(owner), np.int64)
    order = np.argsort(low - high, kind="stable")  # the longest spans first, so that those left stay in front
    ends = np.cumsum(sizes[owner[order]])
    for own in np.split(order, np.flatnonzero(np.diff(ends // LANES)) + 1):
        n = sizes[owner[own]]
        lane = np.repeat(np.arange(len(own)), n)
        piece = np.arange(len(lane)) - np.repeat(np.cumsum(n) - n - (np.cumsum(sizes) - sizes)[owner[own]], n)
        used, row = np.unique(piece, return_inverse=True)
        masks = np.zeros((len(used), 256), np.uint64)
        for mask, k in zip(masks, used):
            np.bitwise_or.at(mask, cut[k], np.uint64(1) << np.arange(len(cut[k]), dtype=np.uint64))
        masks = masks.ravel()
        row, at, size = row * 256, low[own][lane], (high - low)[own][lane]
        top, score = (length[piece] - 1).astype(np.uint64), length[piece].astype(np.uint64)
        best = score.copy()
        plus, minus = np.full(len(lane), ~np.uint64(0)), np.zeros(len(lane), np.uint64)
        left = np.searchsorted(-size, -np.arange(size[0]), "left") if len(size) else ()
        for j, m in enumerate(left):  # as in edit_distance; bits above a piece's last are never read
            p, q, s = plus[:m], minus[:m], score[:m]
            eq = masks[row[:m] + data[at[:m] + j]]
            across = (((eq & p) + p) ^ p) | eq
            up, down = q | ~(across | p), p & across
            s += (up >> top[:m]) & np.uint64(1)
            s -= (down >> top[:m]) & np.uint64(1)
            up <<= np.uint64(1)
            down <<= np.uint64(1)
            eq |= q
            np.bitwise_or(down, ~(eq | up), out=p)
            np.bitwise_and(up, eq, out=q)
            np.minimum(best[:m], s, out=best[:m])
        out[own] = np.bincount(lane, best, len(own)).astype(np.int64)
    return out


@lru_cache(1 << 12)
def seeds_left(n: int, edits: int, size: int, recall: float) -> int:
    """Seeds that ``recall`` of the passages of ``n`` bytes share with the item after random edits."""
    rng = np.random.default_rng([SEED, n, edits])
    spoiled = rng.random((TRIALS, n)).argsort(axis=1) < edits
    whole = ~np.lib.stride_tricks.sliding_window_view(spoiled, size, axis=1).any(axis=2)
    return int(np.sort(whole.sum(axis=1))[int((1 - recall) * TRIALS)])


def codes(data: np.ndarray, size: int) -> np.ndarray:
    """Each run of ``size`` bytes, up to 8, as one number."""
    out, held, part, width = None, 0, data.astype(np.uint64), 1
    while True:
        if size & width:
            out = part if out is None else out[: len(part) - held] << np.uint64(8 * width) | part[held:]
            held += width
        if 2 * width > size:
            return out[: len(data) - size + 1]
        part = part[:-width] << np.uint64(8 * width) | part[width:]
        width *= 2


class Seeds:
    """Seeds of one size from every place of some items, and how many must agree for each item."""

    def __init__(self, size: int, items: dict[int, bytes], most: dict[int, int], asked: dict[int, int], fine: dict[int, int]):
        self.size = size
        self.longest = max(len(items[k]) + most[k] for k in items)
        slots = {k: self.slots(np.frombuffer(f, np.uint8)) for k, f in items.items()}
        slot = np.concatenate(list(slots.values()))
        order = np.argsort(slot, kind="stable")
        self.first = np.searchsorted(slot[order], np.arange((1 << SLOTS) + 1)).astype(np.int32)
        sizes = [len(s) for s in slots.values()]
        self.item = np.repeat(np.array(list(items)), sizes)[order]
        self.offset = np.concatenate([np.arange(n) for n in sizes])[order]
        # Starts that differ by the edits allowed fall into one band or two neighbours.
        n = max(items) + 1
        self.shift, self.asked = np.zeros(n, np.int64), np.ones(n, np.int64)
        for k in items:
            self.shift[k], self.asked[k] = int(most[k]).bit_length(), asked[k]
        self.fine = {}
        for k, least in fine.items():
            code = codes(np.frombuffer(items[k], np.uint8), FINE)
            order = np.argsort(code, kind="stable")
            self.fine[k] = (code[order], order, least, len(items[k]) + most[k], most[k])

    def slots(self, data: np.ndarray) -> np.ndarray:
        return (codes(data, self.size) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def search(self, data: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray):
        """(document, item, least start, greatest start) of every two bands with seeds enough."""
        mask = (1 << SLOTS) - 1
        # A passage over the end of a slice lies within it whole.
        for a in range(0, len(data), SLICE):
            part = data[a : a + SLICE + self.longest]
            if len(part) < self.size:
                continue
            slot = self.slots(part)
            left = self.first[slot]
            count = self.first[slot + 1] - left
            hit = np.flatnonzero(count)
            count = count[hit]
            if not len(hit):
                continue
            end = np.cumsum(count)
            seed = np.repeat(left[hit] - end + count, count) + np.arange(end[-1])
            where = np.repeat(hit, count) + a
            item = self.item[seed]
            band = where - self.offset[seed] + self.longest >> self.shift[item]
            # Counters are shared by chance, which only adds; what passes is counted again exactly.
            key = item * np.int64(0x9E3779B1) + band & mask
            total = np.bincount(key, minlength=mask + 1).astype(np.int32)
            near = total[key] + np.maximum(total[key - 1 & mask], total[key + 1 & mask])
            keep = np.flatnonzero(near >= self.asked[item])
            if not len(keep):
                continue
            # One number for a document, item and band: far below 2 ** 63 for a block's bytes.
            n_bands, n_items = int(band[keep].max()) + 1, len(self.asked)
            rows = (np.searchsorted(doc_ends, where[keep], "right") * n_items + item[keep]) * n_bands + band[keep]
            rows, n = np.unique(rows, return_counts=True)
            rows = np.stack([*np.divmod(rows // n_bands, n_items), rows % n_bands])
            after = np.r_[(rows[:2, 1:] == rows[:2, :-1]).all(axis=0) & (rows[2, 1:] == rows[2, :-1] + 1), False]
            both = n + np.where(after, np.r_[n[1:], 0], 0)
            d, i, b = rows[:, both >= self.asked[rows[1]]]
            least, greatest = (b << self.shift[i]) - self.longest, (b + 2 << self.shift[i]) - self.longest
            order = np.argsort(i, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(i[order])) + 1) if len(order) else ():
                k = int(i[own[0]])
                at, low, high = self._agree(k, data, doc_starts[d[own]], doc_ends[d[own]], least[own], greatest[own])
                for x, *rest in sorted(set(zip(d[own[at]].tolist(), low.tolist(), high.tolist()))):
                    yield x, k, *rest

    def _agree(self, k: int, data: np.ndarray, starts, ends, least, greatest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bands of an item in which as many short seeds as it asks for begin within the edits
        allowed of each other, and the least and greatest start that do."""
        if k not in self.fine:
            return np.arange(len(least)), least, greatest
        code, offset, asked, length, most = self.fine[k]
        low, high = np.maximum(starts, least), np.minimum(ends, greatest + length)
        size = np.maximum(high - low - FINE + 1, 0)
        owner = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        seen = np.zeros(len(at), np.uint64)
        for j in range(FINE):
            seen = seen << np.uint64(8) | data[at + j]
        left = np.searchsorted(code, seen, "left")
        hit = np.flatnonzero(code[np.minimum(left, len(code) - 1)] == seen)
        count = np.searchsorted(code, seen[hit], "right") - left[hit]
        place = offset[np.repeat(left[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        start, owner = np.repeat(at[hit], count) - place, np.repeat(owner[hit], count)
        inside = (start >= least[owner]) & (start < greatest[owner])
        width = 2 << int(self.shift[k])
        n = np.bincount(owner[inside] * width + (start - least[owner])[inside], minlength=len(low) * width).reshape(-1, width)
        total = np.cumsum(np.pad(n, ((0, 0), (1, most))), axis=1)
        enough = total[:, most + 1 :] - total[:, :-most - 1] >= asked  # starts from each on, as far as edits move them
        at = np.flatnonzero(enough.any(axis=1))
        enough = enough[at]
        return at, least[at] + enough.argmax(axis=1), least[at] + width - 1 - enough[:, ::-1].argmax(axis=1) + most


class Index:
    """Windows of a set of items under all walks, and their seeds."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float = MAX_EDITS, recall: float = RECALL):
        self.max_edits = max_edits
        folded = [(i, fold(t).strip(b" ")) for i, t in items]
        self.ids = [i for i, f in folded if f]
        self.items = [f for _, f in folded if f]
        self.short = [k for k, f in enumerate(self.items) if len(f) < SHORTEST]
        long = [k for k, f in enumerate(self.items) if len(f) >= SHORTEST]
        shortest = min((len(self.items[k]) for k in long), default=0)
        self.width = max(min(SHORTEST, shortest), min(LONGEST, int(WINDOW_SHARE * shortest)))
        self.walks, self.tables, self.seeds = [], [], []
        if not long:
            return
        most = {k: int(max_edits * len(self.items[k])) for k in long}
        classes: dict[int, dict[int, int]] = {}
        fine, each = {}, (1 + recall) / 2
        for k in long:
            n = len(self.items[k]) // 8 * 8  # trials serve items of nearly one length
            for size in SEEDS:
                asked = seeds_left(n, min(n, most[k]), size, each)
                if asked >= AGREE:
                    break
            classes.setdefault(size, {})[k] = max(1, asked)
            if size > FINE:
                fine[k] = seeds_left(n, min(n, most[k]), FINE, each)
        for size, asked in classes.items():
            own = {k: self.items[k] for k in asked}
            self.seeds.append(Seeds(size, own, most, asked, {k: fine[k] for k in own if k in fine}))
        block = Block(0, [self.items[k] for k in long])
        block.split()
        inside = block.starts + self.width <= block.doc_ends[block.word_doc] - 1
        first = np.r_[True, block.word_doc[1:] != block.word_doc[:-1]]
        # A passage unedited must hold a window of the document, whichever words these begin at.
        self.stride = int(min(STRIDE, np.bincount(block.word_doc[inside | first]).min()))
        starts = block.starts[inside | first]
        owner = block.word_doc[inside | first]
        self.owner, self.offset = np.array(long)[owner], starts - block.doc_starts[owner]
        for w in range(WALKS):
            walk = Walk(self.width, w)
            self.walks.append(walk)
            for s, key in enumerate(walk.keys(block.data, starts)):
                order = np.argsort(key, kind="stable")
                self.tables.append((w, s, key[order], order))
            walk.embedded = walk.embed(block.data, starts)

    def search(self, block: Block) -> list[tuple[int, int, int, int, int]]:
        """(document in the block, item, edits, start, end in bytes) of every passage found."""
        data = _FOLD[block.data]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        candidates = iter(self._candidates(block, data))
        while some := list(islice(candidates, CANDIDATES)):
            for d, i, low, high in self._possible(block, data, some):
                item, a = self.items[i], int(block.doc_starts[d])
                known = found.get((d, i))
                if known and known[0] == 0:
                    continue
                most = int(self.max_edits * len(item))
                edits, end = edit_distance(item, data[low:high].tobytes(), most)
                if edits <= most and (known is None or edits < known[0]):
                    begin = max(low, low + end - len(item))
                    found[d, i] = (edits, begin - a, low + end - a)
        return [(d, self.ids[i], *rest) for (d, i), rest in sorted(found.items())]

    def _possible(self, block: Block, data: np.ndarray, candidates: list) -> list[tuple[int, int, int, int]]:
        """Distinct (document, item, span to compare) of the candidates, but those whose edits are surely too many."""
        spans = {}
        for d, i, least, greatest in candidates:
            n = len(self.items[i])
            most = int(self.max_edits * n)
            a, b = int(block.doc_starts[d]), int(block.doc_ends[d]) - 1
            spans[d, i, max(a, least - most), min(b, greatest + n + most)] = most
        if len(spans) < FEW:
            return list(spans)
        _, item, low, high = np.array(list(spans)).T
        asked, owner = np.unique(item, return_inverse=True)
        edits = least_edits([self.items[i] for i in asked], data, owner, low, high)
        return [span for (span, most), n in zip(spans.items(), edits.tolist()) if n <= most]

    def _candidates(self, block: Block, data: np.ndarray):
        """(document, item, least and greatest expected start): short items as they are, samples, seeds."""
        for d, i, at in self._sampled(block, data):
            yield d, i, at, at
        for seeds in self.seeds:
            yield from seeds.search(data, block.doc_starts, block.doc_ends)

    def _sampled(self, block: Block, data: np.ndarray):
        """Distinct (document, item, expected place) by exact look-up of short items and by samples."""
        if self.short:
            for d in range(len(block)):
                text = data[block.doc_starts[d] : block.doc_ends[d] - 1].tobytes()
                yield from ((d, k, int(block.doc_starts[d]) + text.find(self.items[k])) for k in self.short if self.items[k] in text)
        if not self.walks:
            return
        block.split()
        nth = np.arange(len(block.starts)) - block.word_from[block.word_doc]
        # The last window of a document may be cut short; its words belong to earlier ones too.
        chosen = np.flatnonzero(nth % self.stride == 0)
        starts, docs = block.starts[chosen], block.word_doc[chosen]
        if not len(starts):
            return
        pairs = []
        for w, walk in enumerate(self.walks):
            for key, (_, _, known, order) in zip(walk.keys(data, starts), self.tables[w * SAMPLES :]):
                left = np.searchsorted(known, key, "left")
                hit = np.flatnonzero(known[np.minimum(left, len(known) - 1)] == key)
                count = np.searchsorted(known, key[hit], "right") - left[hit]
                window = order[np.repeat(left[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
                pairs.append(np.repeat(hit, count) * len(self.owner) + window)
        pairs = np.stack(np.divmod(np.unique(np.concatenate(pairs)), len(self.owner)))
        if not pairs.shape[1]:
            return
        # Embeddings of strings far apart differ nearly everywhere: these need no table of edits.
        keep = np.zeros(pairs.shape[1], bool)
        places, back = np.unique(pairs[0], return_inverse=True)
        for walk in self.walks:
            mine = walk.embed(data, starts[places])
            for part in np.array_split(np.arange(len(back)), -(-len(back) // 20_000)):
                same = (mine[:, back[part]] == walk.embedded[:, pairs[1][part]]).mean(axis=0)
                keep[part] |= same >= SAME
        pairs = pairs[:, keep]
        place = starts[pairs[0]] - self.offset[pairs[1]]
        rows = np.unique(np.stack([docs[pairs[0]], self.owner[pairs[1]], place]), axis=1)
        yield from zip(*(r.tolist() for r in rows))


FIELDS = "item_id long, edits long, start long, end long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, items: int = ITEMS) -> DataFrame:
    """Each passage found: doc_id, item_id, edits, and start, end in UTF-8 bytes of the document.

    A passage counts if at most ``max_edits`` of the item's length in edits lead from the item to
    it, after folding case (A-Z) and white space; of several in a document the best is returned.
    Null and empty texts hold and match nothing; items under 16 bytes count only unedited. Items
    with a null id are reported with a null one. Rows that share a doc_id are searched each. Items
    go to the tasks in blocks of about ``items``, each its own pass over the documents, so what is
    broadcast is bounded however long the benchmark. Other columns are ignored.
    """
    n_blocks = max(1, -(-benchmark.count() // items))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    schema = StructType([docs.schema["doc_id"], *(StructField(n, LongType()) for n in ("item_id", "edits", "start", "end"))])
    found = None
    for n in range(n_blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == n)
        index = Index([(r.item_id, r.text) for r in block.distinct().toLocalIterator()], max_edits)
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            index = sent.value
            for batch in (part for whole in batches for part in slices(whole, "text")):
                at, columns = [], [[] for _ in range(4)]
                for b in blocks(batch.column("text").to_pylist()):
                    for d, *rest in index.search(b):
                        at.append(b.first + d)
                        for column, value in zip(columns, rest):
                            column.append(value)
                arrays = [batch.column("doc_id").take(pa.array(at, pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(c, pa.int64()) for c in columns], names=schema.names)

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, items: int = ITEMS) -> DataFrame:
    """``docs`` without the rows whose text holds a passage of the benchmark; columns unchanged."""
    n_blocks = max(1, -(-benchmark.count() // items))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for n in range(n_blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == n)
        sent = docs.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in block.distinct().toLocalIterator()], max_edits))

        def run(batches, sent=sent):
            for batch in (part for whole in batches for part in slices(whole, "text")):
                leaky = {b.first + d for b in blocks(batch.column("text").to_pylist()) for d, *_ in sent.value.search(b)}
                yield batch.filter(pa.array([i not in leaky for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
