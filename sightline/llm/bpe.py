"""Byte-level merges as a lazily determinised transducer, and streaming decoding.

A token sequence is what the merges give if and only if each token alone and each two neighbours
are. So the last token of every prefix of a piece follows from the last tokens of the shorter
prefixes within reach: it is the longest token that ends there and may follow the one before it.
Of the places where a token may still begin, the first tells all others, so a state is just the
bytes since that place; states and transitions are worked out the first time they are met, and
there are never more than the vocabulary has prefixes. A state puts out the tokens that may end
in it, longest first, and which pairs of tokens may be neighbours is compiled from the merges. A
token is final, and is emitted, once every place where one may still begin follows it, which the
longest token bounds.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .arrow import map_texts
from .chunk_cache import ChunkCache

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MAX_STEPS = 500_000  # transitions, and pairs of neighbours: some 0.1 KB each, in every worker process
MAX_CHUNKS = 600_000
SHORT = 64  # bytes of a piece that is settled from its end


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a vocabulary file: base64 token and rank on each line."""
    rows = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in rows}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges as defined: always the leftmost pair of lowest rank. For short strings."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Ids of one piece, byte by byte."""

    def __init__(self, ranks: dict[bytes, int], max_steps: int = MAX_STEPS):
        self.ranks, self.max_steps = ranks, max_steps
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.reach = max(map(len, ranks))
        self.halves: dict[int, tuple[bytes, bytes] | None] = {}
        self.sides: dict[tuple[int, int], tuple] = {}
        self.neighbours: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states, self.number = [b""], {b"": 0}
        self.outputs: list[tuple[tuple[int, int], ...]] = [()]  # tokens that may end, and their lengths
        self.moves: dict[int, int] = {}

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that the merges join last into ``token``; None if they never form it."""
        rank = self.ranks[token]
        if rank not in self.halves:
            below = {r: i for r, i in self._within(token) if i < rank}
            parts = [self.bytes_of[i] for i in merge(token, below)]
            self.halves[rank] = tuple(parts) if len(parts) == 2 else None
        return self.halves[rank]

    def _within(self, token: bytes):
        for i in range(len(token)):
            for j in range(i + 1, len(token) + 1):
                if (r := self.ranks.get(token[i:j])) is not None:
                    yield token[i:j], r

    def side(self, token: int, which: int) -> tuple[tuple[bytes, int], ...]:
        """Parts that stand at the left (0) or right (1) end while ``token`` is being formed, each
        with the rank of the merge that takes it up."""
        key = (token, which)
        if key not in self.sides:
            out, part, taken = [], self.bytes_of[token], 1 << 60
            while True:
                out.append((part, taken))
                if len(part) == 1:
                    break
                taken, part = self.ranks[part], self.split(part)[which]
            self.sides[key] = tuple(out)
        return self.sides[key]

    def fits(self, before: int, token: int) -> bool:
        """Can ``token`` stand next to ``before``?

        Not if two parts at the border would be merged before either is taken up within its own
        token; of equal ranks the left merge comes first.
        """
        get = self.ranks.get
        return not any(
            (rank := get(x + y)) is not None and rank < x_taken and rank <= y_taken
            for x, x_taken in self.side(before, 1)
            for y, y_taken in self.side(token, 0)
        )

    def _move(self, state: int, byte: int) -> int:
        """Work out a transition: the next state, and what it puts out if it is new."""
        suffix = self.states[state] + bytes((byte,))
        while suffix not in self.prefixes:
            suffix = suffix[1:]
        number = self.number.get(suffix)
        if number is None:
            number = self.number[suffix] = len(self.states)
            self.states.append(suffix)
            tails = (suffix[i:] for i in range(len(suffix)))
            self.outputs.append(tuple(
                (self.ranks[t], len(t)) for t in tails if t in self.ranks and (len(t) == 1 or self.split(t))
            ))
        self.moves[state << 8 | byte] = number
        return number

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece. A piece that is a token is that token, as in the defining library."""
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        if len(self.moves) > self.max_steps:
            self.reset()
        if len(self.neighbours) > self.max_steps:
            self.neighbours.clear()
        out: list[int] = []
        path, ends = [0], [-1]  # of each place since the last settled one: the state, the last token before it
        state, moves, room = 0, self.moves, 8 * self.reach
        long = len(piece) > SHORT
        for byte in piece:
            after = moves.get(state << 8 | byte)
            state = self._move(state, byte) if after is None else after
            path.append(state)
            ends.append(None)
            if long:  # settled as it goes; else only the places on the way back are asked for
                self._end(path, ends, len(ends) - 1)
                if len(ends) > room and (done := self._settled(ends, self.states[state])):
                    out += self._back(path, ends, done)
                    del ends[:done], path[:done]
        return out + self._back(path, ends, len(ends) - 1)

    def _end(self, path: list[int], ends: list, at: int) -> int:
        """The last token before a place."""
        pairs = self.neighbours
        for token, length in self.outputs[path[at]]:
            before = ends[at - length]
            if before is None:
                before = self._end(path, ends, at - length)
            if before < 0:
                break
            pair = before << 32 | token
            fits = pairs.get(pair)
            if fits is None:
                fits = pairs[pair] = self.fits(before, token)
            if fits:
                break
        ends[at] = token
        return token

    def _back(self, path: list[int], ends: list, at: int) -> list[int]:
        """The tokens that lead to a place."""
        out = []
        while at:
            token = ends[at]
            if token is None:
                token = self._end(path, ends, at)
            out.append(token)
            at -= self.length[token]
        return out[::-1]

    def _settled(self, ends: list[int], suffix: bytes) -> int:
        """The last place that the tokens to every possible beginning pass through."""
        last = len(ends) - 1
        at = {last} | {last - n for n in range(1, len(suffix) + 1) if suffix[-n:] in self.prefixes}
        while len(at) > 1:
            last = max(at)
            at.remove(last)
            at.add(last - self.length[ends[last]])
        return at.pop()


class Utf8Machine:
    """Incremental decoding: a state is the bytes of an unfinished character, three at most."""

    @staticmethod
    def limits(lead: int) -> tuple[int, int, int]:
        """Continuation bytes after a lead byte, and the bounds of the first; 0 if it is none."""
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return 0, 0, 0

    def feed(self, held: bytes, data: bytes) -> tuple[str, bytes]:
        """Characters completed by ``data`` and what is then held; each broken sequence is U+FFFD."""
        out = []
        for byte in data:
            if held:
                need, low, high = self.limits(held[0])
                if len(held) > 1:
                    low, high = 0x80, 0xBF
                if low <= byte <= high:
                    held += bytes((byte,))
                    if len(held) == need + 1:
                        out.append(held.decode())
                        held = b""
                    continue
                out.append("�")
                held = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif self.limits(byte)[0]:
                held = bytes((byte,))
            else:
                out.append("�")
        return "".join(out), held


class StreamDecoder:
    """Text of ids, token by token; what a token adds in a state is worked out once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.machine = Utf8Machine()
        self.table: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}

    def decode(self, ids) -> str:
        """Text of ids; null and unknown ids add nothing, an unfinished end is U+FFFD."""
        out, held, table = [], b"", self.table
        here = table[held]
        for i in ids:
            step = here.get(i)
            if step is None:
                step = here[i] = self.machine.feed(held, self.bytes_of.get(i, b""))
            text, after = step
            out.append(text)
            if after != held:
                held = after
                here = table.setdefault(held, {})
        return "".join(out) + ("�" if held else "")


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, content: bytes, max_steps: int = MAX_STEPS, max_chunks: int = MAX_CHUNKS):
        import regex

        ranks = read_ranks(content)
        self.transducer, self.decoder = Transducer(ranks, max_steps), StreamDecoder(ranks)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cache = ChunkCache(lambda chunks: [self._chunk(c) for c in chunks], max_chunks)

    def _chunk(self, chunk: str) -> list[int]:
        return [i for piece in self.pattern.findall(chunk) for i in self.transducer.encode(piece.encode())]

    def encode(self, texts: list) -> list[np.ndarray]:
        return self.cache.ids(texts)


_CODECS: dict[tuple, Codec] = {}


def codec(content: bytes, max_steps: int = MAX_STEPS, max_chunks: int = MAX_CHUNKS) -> Codec:
    """The codec of a vocabulary file's content, built once per process."""
    key = (hashlib.sha256(content).hexdigest(), max_steps, max_chunks)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(content, max_steps, max_chunks)
    return _CODECS[key]


def _content(docs: DataFrame, path: str | None):
    """The vocabulary file, read by the driver and sent to each executor once; its size is fixed."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, carry=("doc_id",), decoded: bool = False,
           max_steps: int = MAX_STEPS, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """``carry`` columns and ``ids``, array of int: the text's tokens without special ones.

    ``decoded`` adds the text that the ids decode to, in the same pass. ``max_steps`` and
    ``max_chunks`` bound what a worker process remembers; they change speed only. A null text counts as
    empty: no ids. Ids may be null or repeated; other columns, an ``ids`` column included, are
    ignored. One pass, no shuffle.
    """
    content = _content(docs, path)

    def make():
        own = codec(content.value, max_steps, max_chunks)

        def run(texts: list) -> dict:
            found = own.encode(texts)
            ends = np.cumsum([0, *map(len, found)])
            values = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            out = {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))}
            if decoded:
                out["decoded"] = [own.decoder.decode(ids.tolist()) for ids in found]
            return out

        return run

    return map_texts(docs, make, "ids array<int>" + ", decoded string" * decoded, carry=carry)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: the text of ``ids`` (null: empty), in place of a column so named."""
    content = _content(encoded, path)
    carry = [c for c in encoded.columns if c != "decoded"]

    def make():
        decoder = codec(content.value).decoder
        return lambda rows: {"decoded": [decoder.decode(ids) for ids in rows]}

    return map_texts(encoded, make, "decoded string", carry=carry, text="ids", read=_id_lists)


def _id_lists(column: pa.ListArray):
    """The ids of each row (null: none), one row at a time."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for a, b in zip(ends[:-1], ends[1:]):
        yield values[a:b].tolist()
