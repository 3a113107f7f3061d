"""Quality by nearest neighbours: labelled texts in latent-semantic space vote on every text.

A text is a bag of hashed terms: its byte trigrams, the trigrams of its shape (letters and digits
folded to their class) and marks of how its words follow one another. Weighted by inverse
document frequency, the labelled sample's bags give the latent directions (a truncated singular
value decomposition). The sample's vectors, whose number is bounded by a parameter, are sent to all
tasks, each of which multiplies them with its texts' vectors block by block; the similarities are
exact, and the nearest neighbours' labels are averaged with their similarity as weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts
from .words import Block, blocks

TERMS = 1024  # hashed trigrams, for each of text and shape
MARKS = 64  # marks of word order, length and line shape
LATENT = 48
SAMPLE = 2000  # labelled rows of each class at most
NEIGHBOURS = 15
SHARPNESS = 8.0  # power of the similarity in a vote
THRESHOLD = 0.7
DOC_BLOCK = 256
WIDTH = 2 * TERMS + MARKS

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def _trigrams(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    return (((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(22)).astype(np.int64)  # 10 bits: TERMS


def _counts(block: Block) -> np.ndarray:
    """Term counts of each text of a block."""
    n = len(block)
    out = np.zeros((n, WIDTH), np.float32)
    lower, shape = _trigrams(_LOWER[block.data]), _trigrams(_SHAPE[block.data])
    for i, (a, b) in enumerate(zip(block.doc_starts, block.doc_ends)):
        if b - a > 3:
            out[i, :TERMS] = np.bincount(lower[a : b - 3], minlength=TERMS)
            out[i, TERMS : 2 * TERMS] = np.bincount(shape[a : b - 3], minlength=TERMS)
    block.split()
    if len(block.starts):
        hashes = block.word_hashes()
        # Distance back to the same word, in steps of powers of two; 0 if it is new in its text.
        keys = hashes + block.word_doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        order = np.argsort(keys, kind="stable")
        back = np.zeros(len(keys), np.int64)
        same = keys[order][1:] == keys[order][:-1]
        back[order[1:][same]] = (order[1:] - order[:-1])[same]
        step = np.minimum(np.log2(np.maximum(back, 1)).astype(np.int64) + (back > 0), 15)
        length = np.minimum((block.ends - block.starts) // 2, 15)
        first = np.minimum(_SHAPE[block.data[block.starts]], 127) // 8
        last = np.minimum(_SHAPE[block.data[block.ends - 1]], 127) // 8
        for k, mark in enumerate((step, length, first, last)):
            at = block.word_doc * WIDTH + 2 * TERMS + 16 * k + mark
            out += np.bincount(at, minlength=n * WIDTH).reshape(n, WIDTH)
    return out


def _weights(counts: np.ndarray) -> np.ndarray:
    """Counts to damped shares, each of the three groups of terms with equal length."""
    parts = []
    for a, b in ((0, TERMS), (TERMS, 2 * TERMS), (2 * TERMS, WIDTH)):
        x = counts[:, a:b]
        x = np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))
        parts.append(x)
    return np.concatenate(parts, axis=1)


def term_vectors(texts: list) -> np.ndarray:
    """One weighted term vector per text; None counts as empty, with the zero vector."""
    parts = [_weights(_counts(b)) for b in blocks(texts, 1 << 18)]
    return np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


@dataclass
class NeighbourModel:
    idf: np.ndarray
    directions: np.ndarray  # terms × latent
    vectors: np.ndarray  # labelled × latent, unit length
    labels: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS
    balance: tuple[float, float] = (1.0, 1.0)  # weight of a vote for 0 and for 1

    def embed(self, terms: np.ndarray) -> np.ndarray:
        return _unit((terms * self.idf) @ self.directions)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """Weighted vote of the nearest labelled vectors; a text without terms gets the prior."""
        out = np.full(len(terms), self.prior)
        k = min(self.neighbours, len(self.labels))
        if not k:
            return out
        for i in range(0, len(terms), DOC_BLOCK):
            part = terms[i : i + DOC_BLOCK]
            cosine = self.embed(part) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
            weight *= np.where(self.labels[near] > 0, self.balance[1], self.balance[0])
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[i : i + DOC_BLOCK] = np.where((total > 1e-12) & part.any(axis=1), vote, self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(terms: np.ndarray, labels: np.ndarray, latent: int = LATENT, prior: float | None = None) -> NeighbourModel:
    """Latent directions and vectors of labelled texts."""
    prior = float(prior if prior is not None else labels.mean() if len(labels) else 0.5)
    if not len(labels):
        return NeighbourModel(np.ones(WIDTH, np.float32), np.zeros((WIDTH, latent), np.float32), np.zeros((0, latent), np.float32), labels, prior)
    share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
    # The sample takes as many rows of either class; votes count as the classes' true shares.
    balance = ((1 - prior) / (1 - share), prior / share) if 0 < prior < 1 else (1.0, 1.0)
    present = (terms > 0).sum(axis=0)
    idf = np.log1p(len(terms) / (1.0 + present)).astype(np.float32)
    x = (terms * idf).astype(np.float64)
    values, directions = np.linalg.eigh(x.T @ x)
    directions = directions[:, np.argsort(values)[::-1][:latent]].astype(np.float32)
    return NeighbourModel(idf, directions, _unit(x.astype(np.float32) @ directions), labels.astype(np.float64), prior, balance=balance)


def fit_model(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> NeighbourModel:
    """Fit on at most ``sample`` labelled rows of each class: those with the least hash.

    ``labels``: doc_id and ``label`` (0, 1; other values and nulls are ignored), already without
    held-out rows. A document labelled twice counts with its least label, one with several texts
    with the least of these. The sample's term
    vectors, of fixed size, are all that comes to the driver.
    """
    key = F.xxhash64(F.lit(11), "doc_id")
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("__label"))
    ranked = [marked.where(F.col("__label") == c).orderBy(key, "doc_id").limit(sample) for c in (0, 1)]
    # 2 × sample rows of (id, label) at most, whatever the size of the tables.
    chosen = ranked[0].union(ranked[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__label").agg(F.min("text").alias("text"))

    def make():
        return lambda texts: {"vector": [v.tobytes() for v in term_vectors(texts).astype(np.float16)]}

    found = map_texts(rows, make, "vector binary", carry=("doc_id", "__label")).orderBy("doc_id")
    counts = {r["__label"]: r["n"] for r in marked.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    y, x = [], []
    for r in found.toLocalIterator():
        y.append(r["__label"])
        x.append(np.frombuffer(r["vector"], np.float16))
    terms = np.array(x, np.float32).reshape(-1, WIDTH)
    total = sum(counts.values())
    return fit(terms, np.array(y, np.float64), prior=counts.get(1, 0) / total if total else 0.5)


def score_quality(docs: DataFrame, model: NeighbourModel) -> DataFrame:
    """Each row's ``doc_id`` and ``score`` (0 to 1, higher: label 1 likelier).

    A null or empty text, or one too short for any term, gets the share of label 1 among the
    labels. Ids may be null or repeated; other columns are ignored. One pass, no shuffle: the
    model's size is fixed by its sample bound.
    """

    def make():
        def run(texts: list) -> dict:
            scores = []
            for i in range(0, len(texts), DOC_BLOCK):  # term vectors are dense: a block at a time
                scores.append(model.score(term_vectors(texts[i : i + DOC_BLOCK])))
            return {"score": pa.array(np.concatenate(scores) if scores else [], pa.float64())}

        return run

    return map_texts(docs, make, "score double")
