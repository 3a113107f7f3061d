"""Quality rules by compression: texts that shrink too well or hardly at all are rejected.

Zstandard is run over the whole text and over fixed chunks of it. Prose of a given length shrinks
by a factor within a narrow band; repetition lies far above it, noise and encoded binaries below.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .arrow import map_texts
from .names import fresh
from .words import SPACES, blocks

# From this many bytes on: least and greatest ratio of text to compressed text. Short texts carry
# the frame's fixed cost and have nothing to repeat, so they get wide bands or none.
BANDS = (
    (0, 0.0, float("inf")),
    (128, 0.0, 3.0),
    (512, 1.2, 3.0),
    (2048, 1.4, 3.5),
    (8192, 1.5, 4.0),
    (65536, 1.6, 5.0),
)
CHUNK_BYTES = 4096
CHUNK_BAND = (1.3, 5.0)
MAX_BAD_CHUNKS = 0.25  # share of chunks outside their band
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of words in repeated windows
WINDOW = 8
LEVEL = 3

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"
)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def measures(texts: list, window: int = WINDOW) -> pd.DataFrame:
    """Counts of each text; None counts as empty."""
    parts = []
    for block in blocks(texts):
        block.split()
        chars = ~block.space & ((block.data & 0xC0) != 0x80)
        grams, whole = block.grams(block.word_hashes(), window)
        at = np.flatnonzero(whole)
        # A window is compared within its text only: the text's number is part of the key.
        keys = grams[at] + block.word_doc[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        twice = at[count[which] > 1]
        cover = np.zeros(len(block.starts) + 1, np.int64)
        cover[twice] += 1
        cover[twice + window] -= 1
        inside = np.r_[0, np.cumsum(np.cumsum(cover[:-1]) > 0)]
        parts.append(
            pd.DataFrame(
                {
                    "n_words": block.n_words,
                    "word_chars": block.sums(chars),
                    "n_symbols": block.sums(_SYMBOLS[block.data]),
                    "n_dup_lines": [repeated_lines(t or "") for t in texts[block.first : block.first + len(block)]],
                    "n_repeat_words": inside[block.word_to] - inside[block.word_from],
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def ratios(blob: bytes, compressor, chunk: int = CHUNK_BYTES) -> tuple[float, list[float]]:
    """Compression ratio of the whole and of each chunk; a tail under half a chunk has none."""
    if not blob:
        return 1.0, []
    whole = len(blob) / len(compressor.compress(blob))
    if len(blob) <= chunk:
        return whole, []
    pieces = (blob[i : i + chunk] for i in range(0, len(blob), chunk))
    return whole, [len(p) / len(compressor.compress(p)) for p in pieces if 2 * len(p) >= chunk]


def band(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    """Limits for a text of this length."""
    return next((lo, hi) for least, lo, hi in reversed(bands) if n_bytes >= least)


def verdicts(
    texts: list,
    compressor,
    bands=BANDS,
    chunk: int = CHUNK_BYTES,
    chunk_band=CHUNK_BAND,
    max_bad_chunks: float = MAX_BAD_CHUNKS,
    min_words: int = MIN_WORDS,
    max_repeated: int = MAX_REPEATED,
) -> pd.DataFrame:
    """The measures of each text, its compression, and whether it is kept."""
    out = measures(texts)
    whole, pieces, bad, fits = [], [], [], []
    for text in texts:
        blob = (text or "").encode("utf-8", "surrogatepass")
        ratio, parts = ratios(blob, compressor, chunk)
        lo, hi = band(len(blob), bands)
        outside = sum(not chunk_band[0] <= r <= chunk_band[1] for r in parts)
        whole.append(ratio)
        pieces.append(len(parts))
        bad.append(outside)
        fits.append(lo <= ratio <= hi and outside <= max_bad_chunks * len(parts))
    out["ratio"], out["n_chunks"], out["n_bad_chunks"] = whole, pieces, bad
    out["base_failed"] = (out.n_words < min_words) | (100 * out.n_repeat_words > max_repeated * out.n_words)
    out["kept"] = ~out.base_failed & np.array(fits, bool)
    return out


def _judge(**limits):
    def make():
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        return lambda texts: verdicts(texts, compressor, **limits).to_dict("series")

    return make


def judge_quality(docs: DataFrame, **limits) -> DataFrame:
    """Each row's ``doc_id`` with its counts, ratio and verdict ``kept``.

    A text fails the base rule with under ``min_words`` words or more than ``max_repeated`` per
    cent of its words in windows of eight that come twice; else it is kept if its ratio lies in
    the band for its length and at most ``max_bad_chunks`` of its chunks lie outside theirs.
    A null or empty text has no words and fails. Ids may be null or repeated: every row is judged
    alone and returned once. Other columns are ignored. One pass, no shuffle.

    ``limits``: ``bands``, ``chunk``, ``chunk_band``, ``max_bad_chunks``, ``min_words`` and
    ``max_repeated`` in place of this module's values.
    """
    return map_texts(docs, _judge(**limits), FIELDS)


def keep_quality(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with all their columns unchanged."""

    (kept,) = fresh(docs.columns, "__kept")

    def make():
        judge = _judge(**limits)()
        return lambda texts: {kept: judge(texts)["kept"]}

    return map_texts(docs, make, f"{kept} boolean", carry=docs.columns).where(kept).drop(kept)
