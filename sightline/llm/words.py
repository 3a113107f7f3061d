"""Vectorised words and word n-grams of many texts at once, for functions that run inside tasks.

Texts are laid end to end as UTF-8 bytes with one line feed after each, in blocks of bounded
size, so that the arrays derived from a block stay small whatever the batch holds. A word is a
run of bytes outside ``\\x20`` and ``\\x09-\\x0D``, which in UTF-8 equals a run of code points
outside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 20
SPACES = " \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self) -> None:
        self.inverse_base = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, self.inverse_base, np.uint64)], dtype=np.uint64)
        return self.up, self.down


POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """``out[i]`` is the polynomial of ``data[:i]``, from which any slice's hash follows."""
    up, _ = POWERS.to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each slice; equal slices get equal hashes wherever they stand."""
    _, down = POWERS.to(len(sums))
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths * _STEP)


class Block:
    """Some whole texts as one byte array."""

    def __init__(self, first: int, blobs: list[bytes]):
        self.first = first  # place of the first text in the batch
        self.blobs = blobs
        self.data = np.frombuffer(b"\n".join([*blobs, b""]), np.uint8)
        sizes = np.fromiter((len(b) + 1 for b in blobs), np.int64, len(blobs))
        self.doc_ends = np.cumsum(sizes)
        self.doc_starts = self.doc_ends - sizes

    def __len__(self) -> int:
        return len(self.blobs)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte, per text, without the line feeds between texts."""
        total = np.r_[0, np.cumsum(per_byte, dtype=np.int64)]
        return total[self.doc_ends - 1] - total[self.doc_starts]

    def split(self) -> None:
        """Find the words: start, end and text of each, and the words' range of each text."""
        space = _IS_SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.r_[0, edge]
        self.space = space
        self.starts, self.ends = edge[0::2], edge[1::2]  # the last byte is a space, so they pair up
        bounds = np.searchsorted(self.starts, np.r_[self.doc_starts, len(self.data)])
        self.word_from, self.word_to = bounds[:-1], bounds[1:]
        self.n_words = self.word_to - self.word_from
        self.word_doc = np.repeat(np.arange(len(self)), self.n_words)

    def word_hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        return slice_hashes(prefix_sums(self.data if data is None else data), self.starts, self.ends)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``k`` words, and which runs lie within one text."""
        n = max(0, len(hashes) - k + 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * _BASE + hashes[j : n + j]
        return mix(out), self.word_doc[:n] == self.word_doc[k - 1 : n + k - 1]


def blocks(texts, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts (None: empty) in order, in blocks of about ``size`` bytes, a longer text alone."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        blob = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if held and total + len(blob) > size:
            yield Block(first, held)
            first, held, total = i, [], 0
        held.append(blob)
        total += len(blob)
    if held:
        yield Block(first, held)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
