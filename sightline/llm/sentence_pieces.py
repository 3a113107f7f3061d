"""Encoding with sentence-piece models (merges by score) that keeps every piece's place in the text.

A text is normalised from left to right: the longest prefix that the model's compiled character map
knows is replaced, and every character that comes out remembers the byte at which its prefix began.
The pieces found on the normalised characters are then projected back: each gets the span of bytes
of the original text that it stands for.

No piece holds a space mark after another character, so a text is cut before spaces and each chunk
is worked out once and remembered; within a chunk no merge crosses two characters that are
neighbours in no piece, so it is cut there too. Both cuts leave the result as it is.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import accumulate, chain, islice, repeat
from operator import add

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import map_texts
from .merges import ROWS, Merges

MODEL = "piece_bpe_32k.model"
MAX_CHUNKS = 200_000  # chunks remembered in every worker process, some 0.3 KB each
LONG = 64  # characters of a chunk worth remembering
GROUP = 1 << 20  # characters of the texts whose new chunks are worked out together
SPACE = "▁"

# Fixed values of the model file's format: field numbers and piece kinds.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, SPACE_AS_SUFFIX, BYTE_FALLBACK, UNKNOWN_TEXT = 3, 24, 35, 44
CHAR_MAP, DUMMY_PREFIX, TRIM_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def read_fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message, in order."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = message[at : at + size], at + size
        yield key >> 3, value


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 whose values are replacements.

    A unit of the trie holds a label, an offset to its children and whether a key ends there; the
    offset's own unit then holds where the replacement starts.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]
        self.memo: dict[str, tuple[str, bool]] = {}

    def __bool__(self) -> bool:
        return bool(self.units)

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _value(self, at: int) -> str:
        start = self.units[at] & 0x7FFFFFFF
        return self.texts[start : self.texts.index(b"\0", start)].decode()

    def longest(self, data: bytes, at: int) -> tuple[str, int] | None:
        """Replacement of the longest known prefix of ``data[at:]`` and its bytes; None: no prefix is known."""
        units, found = self.units, None
        here = self._children(units[0])
        for i in range(at, len(data)):
            here ^= data[i]
            unit = units[here]
            if unit & 0x800000FF != data[i]:
                break
            here ^= self._children(unit)
            if unit >> 8 & 1:
                found = here, i + 1 - at
        return found and (self._value(found[0]), found[1])

    def rules(self) -> Iterator[tuple[bytes, str]]:
        """All keys and their replacements."""
        if not self.units:
            return
        units, labels = np.array(self.units, np.uint32), np.arange(256, dtype=np.uint32)
        open_ = [(b"", self._children(self.units[0]))]
        while open_:
            key, base = open_.pop()
            near = base ^ labels
            near = np.where(near < len(units), near, 0)
            for label in np.flatnonzero((units[near] & 0x800000FF) == labels).tolist():
                if label == 0:
                    continue
                unit = self.units[base ^ label]
                child, longer = (base ^ label) ^ self._children(unit), key + bytes((label,))
                if unit >> 8 & 1:
                    yield longer, self._value(child)
                open_.append((longer, child))


class Pieces:
    """Encoder and decoder of one model file's content."""

    def __init__(self, content: bytes):
        normalizer, trainer, pieces = {}, {}, []
        for field, value in read_fields(content):
            if field == PIECES:
                pieces.append(dict(read_fields(value)))
            elif field == TRAINER:
                trainer |= dict(read_fields(value))
            elif field == NORMALIZER:
                normalizer |= dict(read_fields(value))
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(MODEL_TYPE) != BPE or trainer.get(SPACE_AS_SUFFIX) or not normalizer.get(ESCAPE_SPACES, 1):
            raise ValueError("only models of merges, with spaces marked before words, are read")
        if not set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user-defined or unused pieces are not read")
        self.dummy_prefix, self.trim = bool(normalizer.get(DUMMY_PREFIX, 1)), bool(normalizer.get(TRIM_SPACES, 1))
        self.map = CharMap(normalizer.get(CHAR_MAP, b""))
        self.names = [p[1].decode() for p in pieces]
        normal = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        score = {i: struct.unpack("<f", pieces[i].get(2, bytes(4)))[0] for i in normal}
        self.ids = {self.names[i]: i for i in normal}
        # Merges of one score are equal, else their order is all that counts.
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {self.names[i]: order[score[i]] for i in normal}
        self.unknown = self.kinds.index(UNKNOWN)
        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.byte_ids = None
        if trainer.get(BYTE_FALLBACK):
            at = {self.names[i]: i for i, k in enumerate(self.kinds) if k == BYTE}
            self.byte_ids = [at[f"<0x{b:02X}>"] for b in range(256)]
        self.merges = Merges(self.rank)
        self.id_of = np.array([self.ids.get(name, -1) for name in self.merges.names], np.int32)
        self.merges.of_char[ord(" ")] = self.merges.of_char[ord(SPACE)]  # for texts that only have their spaces marked
        self.plain = not self.map and not self.trim
        self.neighbours = {name[k : k + 2] for name in self.rank for k in range(len(name) - 1)}
        self._find_cuts()

        unknown = trainer.get(UNKNOWN_TEXT, " ⁇ ".encode())
        self.surface = []
        for name, kind in zip(self.names, self.kinds):
            text = {CONTROL: b"", UNKNOWN: unknown}.get(kind, name.replace(SPACE, " ").encode())
            self.surface.append(bytes((int(name[3:5], 16),)) if kind == BYTE else text)

    def _find_cuts(self) -> None:
        """Which characters may stand before a cut: those that leave no space at the end of the chunk."""
        blocked, self.cuts = {" ", SPACE}, SPACE in self.ids and not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.cuts_lines = "\n" not in "".join(self.neighbours)
        after_letters = {pair[1] for pair in self.neighbours if pair[0].isalpha()}
        self.ends_words = set(".,;:!?") - after_letters
        for key, value in self.map.rules():
            key = key.decode()
            if len(key) > 1:
                self.cuts = self.cuts and " " not in key
                self.ends_words.difference_update(key)
            if not value or value[0] in (" ", SPACE) or value[-1] in (" ", SPACE) or key == " ":
                blocked.update(key)
            if "\n" in key or "\n" in value:
                self.cuts_lines = False
        self.blocked = blocked
        self._before_space = re.compile(f"(?<![{re.escape(''.join(sorted(blocked)))}])(?= )")
        self._hard = re.compile(f"[{re.escape(''.join(sorted(blocked - {' '})))}]|  ")

    def chunks(self, text: str) -> list[str]:
        """The text cut before spaces that follow none, and around line ends and before stops
        if no piece holds these beside what they stand by."""
        if not self.cuts:
            return [text]
        if not self.cuts_lines or "\n" not in text:
            parts = self._words(text)
        else:
            parts = []
            for k, line in enumerate(text.split("\n")):
                if k:
                    parts.append("\n")
                if line:
                    parts += self._words(line)
        if self.trim:  # what is trimmed at an end stands in one chunk with what is not
            while len(parts) > 1 and self.blocked.issuperset(parts[0]):
                parts[:2] = [parts[0] + parts[1]]
            while len(parts) > 1 and self.blocked.issuperset(parts[-1]):
                parts[-2:] = [parts[-2] + parts[-1]]
        return parts

    def _words(self, text: str) -> list[str]:
        if self._hard.search(text):
            parts = self._before_space.split(text)
            if not parts[0] and len(parts) > 1:
                del parts[0]
        else:
            first, *others = text.split(" ")
            parts = [" " + p for p in others]
            if first or not parts:
                parts.insert(0, first)
        ends = self.ends_words
        return [q for p in parts for q in ((p[:-1], p[-1]) if p[-1:] in ends and p[-2:-1].isalpha() else (p,))]

    def normalize(self, chunk: str, first: bool = True, last: bool = True) -> tuple[str, list[int]]:
        """The chunk's normalised characters, and for each the byte where what it came from begins;
        one more place for the end. ``first`` and ``last``: the chunk begins and ends a text."""
        data = chunk.encode()
        out, places, at, begin = [], [], 0, None
        if not self.map and not self.trim:
            out, begin = [chunk.replace(" ", SPACE)], 0 if data else None
            sizes = repeat(1, len(data)) if len(data) == len(chunk) else (len(c.encode()) for c in chunk)
            *places, at = accumulate(sizes, initial=0)
        else:
            skip = self.trim and first
            while at < len(data):
                text, size = self._prefix(data, at)
                if begin is None and not (skip and text == " "):
                    begin = at
                if skip:
                    text = text.lstrip(" ")
                if text:
                    out.append(text.replace(" ", SPACE))
                    places += [at] * len(text)
                    skip = self.trim and text[-1] == " "
                at += size
        text = "".join(out)
        if first and self.dummy_prefix and begin is not None:
            text, places = SPACE + text, [begin, *places]
        if self.trim and last:
            kept = len(text.rstrip(SPACE))
            if kept < len(text):
                at = places[kept]
                text, places = text[:kept], places[:kept]
        return text, [*places, at]

    def _prefix(self, data: bytes, at: int) -> tuple[str, int]:
        found = self.map.longest(data, at) if self.map else None
        if found is None:
            lead = data[at]
            size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            found = data[at : at + size].decode(), size
        return found

    def merge(self, text: str) -> list[str]:
        """Pieces of normalised characters: always the leftmost pair that makes the best piece."""
        if len(text) <= LONG:
            return self._merge_short(text)
        neighbours = self.neighbours
        cut = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in neighbours), len(text)]
        runs = (text[a:b] for a, b in zip(cut, cut[1:]))
        return [p for run in runs for p in (self._merge_short(run) if len(run) <= LONG else self._merge(run))]

    def _merge_short(self, text: str) -> list[str]:
        rank, none = self.rank.get, len(self.rank)
        parts = list(text)
        ranks = list(map(rank, map(add, text, text[1:]), repeat(none)))
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            del ranks[i]
            parts[i] += parts.pop(i + 1)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def _merge(self, text: str) -> list[str]:
        """The same with a heap, for runs whose pairs would be searched too often."""
        rank = self.rank.get
        parts: list[str | None] = list(text)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = parts[i]
            j = after[i]
            if left is None or j >= n or len(left) + len(parts[j]) != size:
                continue  # one of the two is part of another piece since
            left = parts[i] = left + parts[j]
            parts[j] = None
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (r := rank(left + parts[j])) is not None:
                    heapq.heappush(heap, (r, i, size + len(parts[j])))
            if (h := before[i]) >= 0 and (r := rank(parts[h] + left)) is not None:
                heapq.heappush(heap, (r, h, size + len(parts[h])))
        return [p for p in parts if p is not None]

    def encode(self, chunk: str, first: bool = True, last: bool = True) -> tuple[list[int], list[int], int]:
        """Ids of a chunk, where each one's bytes end in it, and where the first one's begin.

        Each piece begins where the one before it ends. Of an unknown character's bytes the last
        one has its span and the others are empty, as in the defining library.
        """
        if self.map or self.trim or not chunk:
            text, places = self.normalize(chunk, first, last)
        else:
            text, places = (SPACE if first and self.dummy_prefix else "") + chunk.replace(" ", SPACE), None
        if not text:
            return [], [], 0
        pieces = self.merge(text)
        ids = list(map(self.ids.get, pieces))
        ends = list(accumulate(map(len, pieces)))
        if places is None and len(text) == len(chunk) and chunk.isascii():
            places = ends and [0]  # as many bytes as characters
        else:
            places = places or self.normalize(chunk, first, last)[1]
            ends = [places[k] for k in ends]
        if None in ids:
            ids, ends = self._with_unknown(pieces, ids, ends, places[0])
        return ids, ends, places[0]

    def encode_many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and ends of many short chunks within texts, one after another, how many each has, and
        whether all its characters are known (what it has is to be worked out alone if not).

        For models without a character map, whose text keeps its places.
        """
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(lengths, kind="stable")
        counts, known = np.zeros(len(chunks), np.int64), np.ones(len(chunks), bool)
        parts = []
        for k in range(0, len(order), ROWS):
            at = order[k : k + ROWS]
            width = int(lengths[at[-1]])
            points = np.array([chunks[i] for i in at.tolist()], f"<U{width}").view(np.uint32).reshape(len(at), width)
            symbols, sizes = self.merges.run(points, lengths[at])
            inside = np.arange(width) < lengths[at][:, None]
            octets = inside * (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
            # Bytes before each character, and the row's bytes at the end.
            before = np.concatenate([np.zeros((len(at), 1), np.int64), np.cumsum(octets, 1)], 1)
            real = sizes > 0
            ids = np.where(symbols >= 0, self.id_of[symbols], -1)
            known[at] = ((ids >= 0) | ~real).all(1)
            ends = np.take_along_axis(before, np.cumsum(sizes, 1), 1)
            counts[at] = real.sum(1)
            parts.append(np.stack([ids[real], ends[real]], 1).astype(np.int32))
        rows = np.concatenate(parts) if parts else np.zeros((0, 2), np.int32)
        # From the order of lengths back to that of the chunks.
        start = np.zeros(len(chunks), np.int64)
        start[order] = np.cumsum(counts[order]) - counts[order]
        upto = np.cumsum(counts)
        rows = rows[np.repeat(start - (upto - counts), counts) + np.arange(len(rows))]
        return rows[:, 0], rows[:, 1], counts, known

    def _with_unknown(self, pieces: list[str], ids: list, ends: list[int], begin: int) -> tuple[list[int], list[int]]:
        """Bytes of unknown characters, or one unknown id for each run of them."""
        out, places, unknown = [], [], False
        for piece, known, end in zip(pieces, ids, ends):
            if known is None and self.byte_ids:
                blob = piece.encode()
                out += [self.byte_ids[x] for x in blob]
                places += [places[-1] if places else begin] * (len(blob) - 1) + [end]
            elif known is None and unknown:
                places[-1] = end
            else:
                out.append(self.unknown if known is None else known)
                places.append(end)
            unknown = known is None
        return out, places

    def decode(self, ids) -> str:
        """Text of ids; ids that are no piece add nothing, and bytes join no farther than to a control id."""
        kinds, size = self.kinds, len(self.kinds)
        ids = [i for i in ids if i is not None and 0 <= i < size]
        controls = [k for k, i in enumerate(ids) if kinds[i] == CONTROL] if not self.controls.isdisjoint(ids) else []
        runs = [ids[a:b] for a, b in zip([0, *(k + 1 for k in controls)], [*controls, len(ids)])]
        drop = 0
        if self.dummy_prefix or self.trim:  # the space mark of the beginning is no part of the text
            for i in chain.from_iterable(runs):
                if kinds[i] != NORMAL or not self.names[i].startswith(SPACE):
                    break
                drop += 1
                if len(self.names[i]) > 1 or not self.trim:
                    break
        surface = self.surface.__getitem__
        return "".join(_as_text(b"".join(map(surface, run))) for run in runs)[drop:]


def _as_text(blob: bytes) -> str:
    try:
        return blob.decode()
    except UnicodeDecodeError:
        return _replaced(blob)


def _replaced(blob: bytes) -> str:
    """UTF-8 text in which every byte that is part of no character is U+FFFD."""
    out, at = [], 0
    while at < len(blob):
        lead = blob[at]
        size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            out.append(blob[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


class _Known(dict):
    """Chunk to number; a chunk that is not known is encoded and gets the next one."""

    def __init__(self, add, first: bool):
        self.add, self.is_first = add, first

    def __missing__(self, chunk: str) -> int:
        number = self.add(chunk, self.is_first)
        if len(chunk) <= LONG:
            self[chunk] = number
        return number


class Rows:
    """Rows of numbers that grow at the end."""

    def __init__(self, width: int, kind):
        self.data, self.size = np.zeros((1 << 12, width), kind), 0

    def extend(self, rows: np.ndarray) -> None:
        upto = self.size + len(rows)
        while upto > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.size : upto] = rows
        self.size = upto


class Memo:
    """Ids and spans of whole texts, each distinct chunk worked out once while there is room."""

    def __init__(self, pieces: Pieces, limit: int = MAX_CHUNKS):
        self.pieces, self.limit = pieces, limit
        self.first, self.inner = _Known(self.add, True), _Known(self.add, False)
        self.count, self.new = 0, []
        self.chunks = Rows(4, np.int64)  # where a chunk's ids end, how many, its bytes, and where they begin
        self.flat = Rows(2, np.int32)  # id, and where its bytes end

    def add(self, chunk: str, first: bool) -> int:
        self.new.append((chunk, first))
        self.count += 1
        return self.count - 1

    def _settle(self) -> None:
        """Work out the new chunks."""
        new, self.new = self.new, []
        lengths = np.fromiter((len(c.encode()) for c, _ in new), np.int64, len(new))
        begins, sizes = np.zeros((2, len(new)), np.int64)
        some = [k for k, (c, first) in enumerate(new) if self.pieces.plain and not first and 0 < len(c) <= LONG]
        ids, ends, counts, known = self.pieces.encode_many([new[k][0] for k in some])
        fast = np.zeros(len(new), bool)
        fast[some] = known
        sizes[some] = counts
        alone = {}
        for k in np.flatnonzero(~fast).tolist():
            alone[k] = self.pieces.encode(*new[k], False)
            sizes[k], begins[k] = len(alone[k][0]), alone[k][2]
        after = np.cumsum(sizes)
        rows = np.empty((int(sizes.sum()), 2), np.int32)
        from_fast = np.repeat(known, counts)
        rows[np.repeat(fast, sizes)] = np.stack([ids[from_fast], ends[from_fast]], 1)
        for k, (own_ids, own_ends, _) in alone.items():
            rows[after[k] - sizes[k] : after[k]] = np.array([own_ids, own_ends], np.int32).T
        self.chunks.extend(np.stack([self.flat.size + after, sizes, lengths, begins], 1))
        self.flat.extend(rows)

    def encode(self, text: str) -> np.ndarray:
        """Rows of id, start and end of a text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The same for many texts: new chunks of some are worked out together."""
        out, held, size = [], [], 0
        for k, text in enumerate(texts):
            parts = self.pieces.chunks(text)
            tail = parts.pop() if self.pieces.trim else None  # the end of a text may be trimmed
            inner = self.inner.__getitem__
            whole = chain((self.first[parts[0]],), map(inner, islice(parts, 1, None))) if parts else ()
            held.append((np.fromiter(whole, np.int64, len(parts)), tail))
            size += len(text)
            if size >= GROUP or k == len(texts) - 1:
                if self.new:
                    self._settle()
                out += [self._rows(*h) for h in held]
                held, size = [], 0
                if self.count > self.limit or self.flat.size > 8 * self.limit:
                    self.forget()
        return out

    def _rows(self, numbers: np.ndarray, tail: str | None) -> np.ndarray:
        rows, begin, where = np.zeros((0, 2), np.int32), 0, 0
        if len(numbers):
            ends, sizes, lengths, begins = self.chunks.data[numbers].T
            upto, after = np.cumsum(sizes), np.cumsum(lengths)
            rows = self.flat.data[np.repeat(ends - upto, sizes) + np.arange(upto[-1])]
            rows[:, 1] += np.repeat(after - lengths, sizes).astype(np.int32)
            begin, where = int(begins[0]), int(after[-1])
        if tail is not None:
            ids, ends, first = self.pieces.encode(tail, not len(numbers), True)
            begin = begin if len(numbers) else first
            rows = np.concatenate([rows, np.array([ids, ends], np.int32).T + np.array([0, where], np.int32)])
        starts = np.empty(len(rows), np.int32)
        starts[:1], starts[1:] = begin, rows[:-1, 1]
        return np.stack([rows[:, 0], starts, rows[:, 1]], 1)

    def forget(self) -> None:
        """Keep the first half of the chunks: frequent ones are met first."""
        self.count //= 2
        for known in (self.first, self.inner):
            kept = [(chunk, number) for chunk, number in known.items() if number < self.count]
            known.clear()
            known.update(kept)
        self.chunks.size = self.count
        self.flat.size = int(self.chunks.data[self.count - 1, 0]) if self.count else 0


_MEMOS: dict[tuple, Memo] = {}


def memo(content: bytes, max_chunks: int = MAX_CHUNKS) -> Memo:
    """Encoder of a model file's content, built once per process."""
    key = hashlib.sha256(content).hexdigest(), max_chunks
    if key not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[key] = Memo(Pieces(content), max_chunks)
    return _MEMOS[key]


def _content(docs: DataFrame, path: str | None):
    """The model file, read by the driver and sent to each executor once; its size is fixed."""
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, carry=("doc_id",), decoded: bool = False, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """``carry`` columns, ``ids``, ``starts`` and ``ends``: the text's pieces and the bytes each stands for.

    Byte ``starts[i]`` up to ``ends[i]`` of the UTF-8 text is what piece ``i`` was made from; the
    piece that only holds the space put before the text is empty. ``decoded`` adds the text of the
    ids, in the same pass. ``max_chunks`` bounds what a worker process remembers and changes speed
    only. A null text counts as empty: no ids. Ids may be null or repeated; every row is encoded
    alone; other columns are ignored. One pass, no shuffle.
    """
    content = _content(docs, path)

    def make():
        own = memo(content.value, max_chunks)

        def run(texts: list) -> dict:
            found = own.encode_all([t or "" for t in texts])
            places = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            rows = np.concatenate(found) if found else np.zeros((0, 3), np.int32)
            columns = (pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3))
            out = {name: pa.ListArray.from_arrays(places, c) for name, c in zip(("ids", "starts", "ends"), columns)}
            if decoded:
                out["decoded"] = [own.pieces.decode(r[:, 0].tolist()) for r in found]
            return out

        return run

    return map_texts(docs, make, "ids array<int>, starts array<int>, ends array<int>" + ", decoded string" * decoded, carry=carry)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: the text of ``ids`` (null: empty), in place of a column so named.

    Control ids, nulls and numbers outside the vocabulary add nothing.
    """
    content = _content(encoded, path)

    def make():
        pieces = memo(content.value).pieces
        return lambda rows: {"decoded": [pieces.decode(ids or ()) for ids in rows]}

    return map_texts(encoded, make, "decoded string", carry=[c for c in encoded.columns if c != "decoded"], text="ids")
