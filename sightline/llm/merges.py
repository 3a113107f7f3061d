"""Merges by rank over many short strings at once: each round joins one pair in every string.

Strings are rows of a matrix of symbols. A round finds the leftmost pair of least rank in each row,
replaces it by the symbol of the joined piece and looks up the two new pairs beside it. Rows without
a pair leave the matrix, so all rows of a round have the same width.
"""

from __future__ import annotations

import numpy as np

ROWS = 4096  # strings of like length worked on together
NONE = np.int32(2**31 - 1)


class Merges:
    """``rank`` maps a piece to its rank, least first; pieces of one rank join from the left."""

    def __init__(self, rank: dict[str, int]):
        chars = {c for piece in rank for c in piece} - rank.keys()
        self.names = [*rank, *sorted(chars)]
        number = {name: k for k, name in enumerate(self.names)}
        self.count = len(self.names)
        self.of_char = np.full(0x110000, -1, np.int32)
        for name, k in number.items():
            if len(name) == 1:
                self.of_char[ord(name)] = k
        pairs = [
            (number[a] * self.count + number[b], number[piece])
            for piece in rank for i in range(1, len(piece))
            if (a := piece[:i]) in number and (b := piece[i:]) in number
        ]
        keys, joined = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self.keys, self.joined = keys, joined.astype(np.int32)
        self.rank = np.array([rank.get(name, NONE) for name in self.names], np.int32)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of the joined piece; ``NONE`` where the two make none."""
        key = left.astype(np.int64) * self.count + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        joined = np.where(known, self.joined[at], -1)
        return np.where(known, self.rank[joined], NONE), joined

    def run(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (-1: an unknown character) and lengths of the pieces of each row of code points.

        Places after a row's last piece have length 0.
        """
        symbols = np.where(np.arange(points.shape[1]) < lengths[:, None], self.of_char[points], -1)
        sizes = (np.arange(points.shape[1]) < lengths[:, None]).astype(np.int32)
        out, out_sizes = symbols.copy(), sizes.copy()
        live = np.arange(len(points))
        ranks, joined = self.pair(symbols[:, :-1], symbols[:, 1:])
        while ranks.shape[1] and len(live):
            at = ranks.argmin(1)
            rows = np.arange(len(live))
            more = ranks[rows, at] != NONE
            if not more.all():
                done, width = live[~more], symbols.shape[1]
                out[done, :width], out_sizes[done, :width], out_sizes[done, width:] = symbols[~more], sizes[~more], 0
                symbols, sizes, ranks, joined, live, at = (x[more] for x in (symbols, sizes, ranks, joined, live, at))
                rows = np.arange(len(live))
            if not len(live):
                break
            symbols[rows, at] = joined[rows, at]
            sizes[rows, at] += sizes[rows, at + 1]
            columns = np.arange(symbols.shape[1] - 1)
            keep = columns + (columns > at[:, None])
            symbols, sizes = np.take_along_axis(symbols, keep, 1), np.take_along_axis(sizes, keep, 1)
            keep = columns[:-1] + (columns[:-1] >= at[:, None])
            ranks, joined = np.take_along_axis(ranks, keep, 1), np.take_along_axis(joined, keep, 1)
            for side in (at - 1, at):
                ok = (side >= 0) & (side < ranks.shape[1])
                r, c = rows[ok], side[ok]
                ranks[r, c], joined[r, c] = self.pair(symbols[r, c], symbols[r, c + 1])
        width = symbols.shape[1]
        out[live, :width], out_sizes[live, :width], out_sizes[live, width:] = symbols, sizes, 0
        return out, out_sizes
