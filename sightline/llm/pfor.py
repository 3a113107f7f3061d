"""Patched frame-of-reference coding of id sequences, and the files that hold them.

A block of 256 values stores its minimum, the differences from it packed at the width that a given
share of them fits, and, for the others, their places and upper bits in an exception list.

File: magic, then little-endian counts (documents, ids, blocks), the blocks, the index of block
starts (64-bit, one more than blocks), and the document table: for each document a null mark, its
id and its number of ids.
Block: minimum (u32), width (u8), exceptions (u16), bytes of an exception's upper part (u8), the
packed differences (32 x width bytes), places (u8 each), upper parts.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PFORIDS1"
BLOCK = 256
SHARE = 0.9  # of a block's values that its width must fit
HEADER = struct.Struct("<8sQQQ")
BLOCK_HEADER = struct.Struct("<IBHB")
DOCUMENT = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("n_ids", "<u8")])


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits of each value (0: none); exact, as doubles hold 32-bit values."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width to rows of bytes."""
    kind = "<u2" if width <= 16 else "<u4"
    bits = np.unpackbits(low.astype(kind).view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits.reshape(len(low), BLOCK, -1)[:, :, :width].reshape(len(low), -1), axis=1, bitorder="little")


def _unpack(rows: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``_pack``."""
    size = 16 if width <= 16 else 32
    bits = np.zeros((len(rows), BLOCK, size), np.uint8)
    bits[:, :, :width] = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(rows), BLOCK, width)
    return np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").view(f"<u{size // 8}").astype(np.uint32)


def pack_blocks(values: np.ndarray, share: float = SHARE) -> list[bytes]:
    """Blocks of ``values`` (below 2**32); the last is filled up with its minimum."""
    out: list[bytes] = []
    for at in range(0, len(values), 512 * BLOCK):
        part = values[at : at + 512 * BLOCK]
        n = -(-len(part) // BLOCK)
        rows = np.full((n, BLOCK), part[(n - 1) * BLOCK :].min(), np.uint32)
        rows.reshape(-1)[: len(part)] = part
        out += _pack_rows(rows, share)
    return out


def _pack_rows(rows: np.ndarray, share: float) -> list[bytes]:
    least = rows.min(axis=1)
    over = rows - least[:, None]
    bits = _bits(over)
    place = min(BLOCK - 1, int(np.ceil(share * BLOCK)) - 1)
    widths = np.partition(bits, place, axis=1)[:, place]
    packed: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        if width:
            low = over[at] & np.uint32((1 << int(width)) - 1)
            for i, row in zip(at, _pack(low, int(width))):
                packed[i] = row.tobytes()
    row, column = np.nonzero(bits > widths[:, None])
    upper = over[row, column] >> widths[row].astype(np.uint32)
    ends = np.searchsorted(row, np.arange(len(rows) + 1))
    most = np.zeros(len(rows), np.uint32)
    np.maximum.at(most, row, upper)
    sizes = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    places, uppers = column.astype(np.uint8), {s: upper.astype(f"<u{s}") for s in (1, 2, 4)}
    out = []
    for i, (low, width, size) in enumerate(zip(least.tolist(), widths.tolist(), sizes.tolist())):
        a, b = ends[i], ends[i + 1]
        out.append(BLOCK_HEADER.pack(low, width, b - a, size) + packed[i] + places[a:b].tobytes() + uppers[size][a:b].tobytes())
    return out


def unpack_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of 256 values: the blocks that start at ``starts`` of a file's bytes."""
    starts = starts.astype(np.int64)
    head = data[starts[:, None] + np.arange(BLOCK_HEADER.size)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    widths, counts, sizes = head[:, 4].astype(np.int64), np.ascontiguousarray(head[:, 5:7]).view("<u2")[:, 0].astype(np.int64), head[:, 7]
    over = np.zeros((len(starts), BLOCK), np.uint32)
    body = starts + BLOCK_HEADER.size
    for width in np.unique(widths[widths > 0]):
        at = np.flatnonzero(widths == width)
        over[at] = _unpack(data[body[at, None] + np.arange(BLOCK // 8 * width)], int(width))
    body = body + BLOCK // 8 * widths
    row = np.repeat(np.arange(len(starts)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    column = data[body[row] + nth]
    first = body[row] + counts[row] + nth * sizes[row]
    upper = np.zeros(len(row), np.uint32)
    for k in range(4):
        has = sizes[row] > k
        upper[has] |= data[first[has] + k].astype(np.uint32) << np.uint32(8 * k)
    over[row, column] |= upper << widths[row].astype(np.uint32)
    return over + least[:, None]


def write(doc_ids: list, ids: list[np.ndarray], share: float = SHARE) -> bytes:
    """A file of documents (id or None) and their ids."""
    values = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    blocks = pack_blocks(values, share)
    starts = HEADER.size + np.cumsum([0, *map(len, blocks)])
    table = np.zeros(len(doc_ids), DOCUMENT)
    table["null"] = [d is None for d in doc_ids]
    table["doc_id"] = [0 if d is None else d for d in doc_ids]
    table["n_ids"] = [len(i) for i in ids]
    head = HEADER.pack(MAGIC, len(doc_ids), len(values), len(blocks))
    return b"".join([head, *blocks, starts.astype("<u8").tobytes(), table.tobytes()])


class File:
    """Random access to a file's content."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.n_ids, self.n_blocks = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        self.data = np.frombuffer(data, np.uint8)
        self.documents = np.frombuffer(data, DOCUMENT, self.n_docs, len(data) - DOCUMENT.itemsize * self.n_docs)
        index_at = len(data) - DOCUMENT.itemsize * self.n_docs - 8 * (self.n_blocks + 1)
        self.index = np.frombuffer(data, "<u8", self.n_blocks + 1, index_at)
        self.ends = np.cumsum(self.documents["n_ids"])

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file; only the blocks that hold them are read."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-end // BLOCK)
        values = [unpack_blocks(self.data, self.index[b : min(b + 512, last)]).reshape(-1) for b in range(first, last, 512)]
        return np.concatenate(values)[start - first * BLOCK : end - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k] - self.documents["n_ids"][k]), int(self.ends[k]))

    def runs(self, size: int = 1 << 18):
        """(document number, its ids) in order, decoding each block once."""
        held, at, base = np.zeros(0, np.uint32), 0, 0
        for k, end in enumerate(self.ends):
            end = int(end)
            if end - base > len(held):
                upto = min(self.n_ids, max(end, at + size))
                held = np.concatenate([held[at - base :], self.slice(base + len(held), upto)]) if base + len(held) < upto else held[at - base :]
                base = at
            yield k, held[at - base : end - base]
            at = end
