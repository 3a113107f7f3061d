"""Token ids of whole texts through a cache of the short chunks that texts are cut into.

The pre-tokenizing pattern of byte-level vocabularies never matches across the border before a
single space between two other characters, so a text may be cut there and each chunk encoded
alone. Chunks repeat a lot. The cache is bounded: when full, it keeps those it met first, which are
the frequent ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain, islice

import numpy as np

LIMIT = 600_000
_ADJACENT = re.compile(r"\s\s")
_SINGLE = re.compile(r"(?<!\s) (?!\s)")


def pieces(text: str) -> list[str]:
    """``text`` cut at each single space between other characters; those spaces are left out.

    A single line feed between other characters is matched alone, so a piece may begin with it.
    """
    return _SINGLE.split(text) if _ADJACENT.search(text) else text.replace("\n", " \n").split(" ")


def chunk(piece: str) -> str:
    """The part of the text that a piece after the first stands for."""
    return piece if piece[:1] == "\n" else " " + piece


class _Numbers(dict):
    """Piece to number; a piece that is not known gets the next one and waits to be encoded."""

    def __init__(self, cache: ChunkCache, as_text: Callable[[str], str]):
        self.cache, self.as_text = cache, as_text

    def __missing__(self, piece: str) -> int:
        waiting = self.cache.waiting
        number = self[piece] = self.cache.known + len(waiting)
        waiting.append(self.as_text(piece))
        return number

    def keep(self, below: int) -> None:
        kept = [(p, n) for p, n in self.items() if n < below]
        self.clear()
        self.update(kept)


class ChunkCache:
    """``encode`` maps a list of chunks to the list of their ids.

    Pieces are numbered; the ids of all known ones lie end to end in one array, from which those
    of a text are gathered.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int = LIMIT):
        self.encode, self.limit = encode, limit
        self.known, self.waiting = 0, []
        self.first, self.inner = _Numbers(self, str), _Numbers(self, chunk)
        self.ends = np.zeros(1 << 12, np.int64)  # ends[n + 1]: where the ids of piece n end
        self.flat = np.zeros(1 << 14, np.uint32)

    def _settle(self) -> None:
        """Encode what waits and add its ids."""
        found = self.encode(self.waiting)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        start, total, upto = int(self.ends[self.known]), int(sizes.sum()), self.known + len(found)
        while upto + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while start + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.ends[self.known + 1 : upto + 1] = start + np.cumsum(sizes)
        self.flat[start : start + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.known, self.waiting = upto, []

    def ids(self, texts: list) -> list[np.ndarray]:
        """Ids of each text; None counts as empty."""
        if self.known > self.limit:
            self.known = self.limit // 2
            self.first.keep(self.known)
            self.inner.keep(self.known)
        out = []
        for i in range(0, len(texts), 64):  # a few at a time, so that the lists of pieces stay short
            cut = [pieces(t or "") for t in texts[i : i + 64]]
            sizes = np.fromiter(map(len, cut), np.int64, len(cut))
            numbers = np.fromiter(
                chain.from_iterable(chain((self.first[c[0]],), map(self.inner.__getitem__, islice(c, 1, None))) for c in cut),
                np.int64, int(sizes.sum()),
            )
            if self.waiting:
                self._settle()
            starts = self.ends[numbers]
            counts = self.ends[numbers + 1] - starts
            after = np.cumsum(counts)
            ids = self.flat[np.repeat(starts - after + counts, counts) + np.arange(after[-1])]
            out += np.split(ids, after[np.cumsum(sizes) - 1][:-1])
        return out
