"""Secrets in texts: fixed patterns, and a character network over every other candidate in its context.

Candidates are long runs of token characters. The network is trained on labelled findings of every
text: what the patterns find, secrets of common makes planted into contexts of the text, and, as
non-secrets, its other candidates and planted look-alikes. Shards of the texts train from one
start side by side, for a few rounds; after each, the mean over all rows is the next start. A long
candidate is read in overlapping pieces over its whole length; the likeliest counts. A quarter held
out, of all texts again, calibrates the probabilities and sets, for each kind of context, the
threshold that keeps the wanted recall.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.support import cut_lineage, spread
from .arrow import map_texts
from .char_cnn import AFTER, BEFORE, LENGTH, CharCNN, encode, pieces, recall_threshold

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LONG = 20  # characters of a candidate, at least
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LONG},}}")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS = 8, 16

TRAIN_TEXTS = 8000  # of a shard, about
TRAIN_ROWS = 4000  # findings planted in all texts, at least; one or more in each
RATES = (3e-3, 3e-3, 2e-3, 1e-3)  # of the rounds that the shards train, each from the mean of the round before
ROUND_ROWS = 16384  # that a shard learns from in a round, at least: a smaller one takes its rows again
HELD_OUT = 0.25
BINS = 64  # of a logit's unit, in which held-out findings are counted
FIXED = 2.0**20  # parameters are summed as whole numbers of this part, so that no order matters
CUTS = 6  # contexts taken from each text
PIECES = 8  # pieces of one long finding to train on, at most
RECALL = 0.98
SEED = 7
WORDS = ["value", "name", "part", "file", "page"]  # for texts without words

FIELDS = "findings array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the fixed patterns find: (kind, start, end) in code points."""
    found = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # Hex digits are token characters, so a long run of them lies within a candidate.
    for run in RUN.finditer(text):
        found += [("hex", *m.span()) for m in HEX.finditer(text, *run.span())]
    return found


def other_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Candidates: long runs, or what fixed findings leave of them where that is long itself."""
    found = []
    for run in RUN.finditer(text):
        start, end = run.span()
        for s, e in sorted((s, e) for _, s, e in base if s < end and start < e):
            if s - start >= LONG:
                found.append((start, s))
            start = max(start, e)
        if end - start >= LONG:
            found.append((start, end))
    return found


def window(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER]


def named(before: str) -> int:
    """Kind of context: 1 if the text before ends like a label with a sign (``key=``, ``x: "``)."""
    return int(bool(re.search(r"\w[\"']?\s*[:=]\s*[\"']?$", before)))


@dataclass
class SecretModel:
    network: CharCNN
    thresholds: tuple[float, float]  # without, with a label before
    precision: tuple[float, float]  # of what each accepts among held-out findings

    def score(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        """Probability of each: that of its likeliest piece."""
        return self.network.probabilities(self.network.best_logits(windows))

    def accepts(self, windows: list[tuple[str, str, str]], scores: np.ndarray) -> list[bool]:
        return [s >= self.thresholds[named(w[0])] for w, s in zip(windows, scores)]


def planted(
    contexts: list[tuple[str, str]], words: list[str], n: int, rng: np.random.Generator, first: int = 0
) -> list[tuple[tuple[str, str, str], int]]:
    """Made secrets (1) and look-alikes (0) within the contexts by turns, ``first`` before the other."""
    alnum = string.ascii_letters + string.digits
    draw = lambda chars, a, b: "".join(rng.choice(list(chars), rng.integers(a, b)))
    pick = lambda items: items[rng.integers(len(items))]
    some = lambda: [pick(words) for _ in range(rng.integers(3, 7))]
    secrets = (
        lambda: draw(alnum + "+/", 24, 64) + pick(["", "=", "=="]),
        lambda: draw("0123456789abcdef", 24, 31),
        lambda: draw("0123456789ABCDEF", 32, 64),
        lambda: pick(["sk_live_", "sk-", "ghp_", "xoxb-", "glpat-"]) + draw(alnum, 24, 40),
        lambda: "eyJ" + draw(alnum + "-_", 30, 60),
        lambda: draw(alnum + "-_", 20, 44),
    )
    alike = (
        lambda: "".join(some()),
        lambda: "".join(w.capitalize() for w in some()),
        lambda: "_".join(some()),
        lambda: "-".join(some()),
        lambda: "/".join(some()),
        lambda: "".join(some()).upper(),
        lambda: draw(string.digits, 20, 30),
        lambda: pick(list("=-_+/")) * int(rng.integers(20, 60)),
        lambda: f"{pick(words)}_{draw(string.digits, 4, 10)}-{pick(words)}_{draw(string.digits, 1, 4)}",
        lambda: pick(words) * int(rng.integers(4, 9)),
    )
    rows = []
    for i in range(n):
        before, after = contexts[i % len(contexts)]
        label = (first + i) % 2
        value = pick(secrets if label else alike)()
        if rng.random() < 0.4:
            before += pick(["key", "auth", "id", "value", "name", "ref"]) + pick(["=", ": ", ' = "', '": "'])
        value = (value + draw(string.ascii_lowercase, 20, 21)) if len(value) < 20 else value
        rows.append(((before[-BEFORE:], value, after[:AFTER]), label))
    return rows


def examples(text: str, rng: np.random.Generator) -> tuple[list, list, list]:
    """Labelled findings of a text, and contexts and words of it to plant others with."""
    base = base_spans(text)
    labelled = [(window(text, s, e), 1) for _, s, e in base]
    # What stands beside a finding in one run may well be a secret: no example of either kind.
    whole = {m.span() for m in RUN.finditer(text)}
    labelled += [(window(text, s, e), 0) for s, e in other_spans(text, base) if (s, e) in whole]
    spaces = [m.start() for m in re.finditer(" ", text)]
    cuts = rng.choice(spaces, min(CUTS, len(spaces)), replace=False) if spaces else ()
    contexts = [(text[max(0, at - BEFORE) : at + 1], text[at : at + AFTER]) for at in cuts]
    return labelled, contexts, re.findall(r"[A-Za-z]{3,12}", text)


def train(texts: list[str], rows: int = TRAIN_ROWS, recall: float = RECALL, seed: int = SEED) -> SecretModel:
    """Fit, calibrate and set thresholds on the findings of texts in memory, ``rows`` with planted ones."""
    rng = np.random.default_rng(seed)
    labelled, contexts, words = [], [], set()
    for text in texts:
        found, around, own = examples(text, rng)
        labelled += found
        contexts += around
        words.update(own)
    words = sorted(words)[:5000] or WORDS
    contexts = contexts or [("", "")]
    labelled = labelled[: rows // 2]
    labelled += planted(contexts, words, rows - len(labelled), rng)
    labels = np.array([y for _, y in labelled], np.float32)
    held = rng.random(len(labels)) < HELD_OUT
    # A part of a long secret is one as well, and a part of another run is none.
    parts = [(p, y) for (w, y), h in zip(labelled, held) if not h for p in islice(pieces(*w), PIECES)]
    network = CharCNN.fresh(rng)
    network.fit(encode([p for p, _ in parts]), np.array([y for _, y in parts], np.float32), rng)
    logits = network.best_logits([w for (w, _), h in zip(labelled, held) if h])
    network.calibrate(logits, labels[held])
    scores = network.probabilities(logits)
    groups = np.array([named(w[0]) for (w, _), h in zip(labelled, held) if h])
    known = labels[held] > 0
    thresholds = tuple(recall_threshold(scores[groups == g], known[groups == g], recall) for g in (0, 1))
    accepted = [(groups == g) & (scores >= t) for g, t in enumerate(thresholds)]
    kept = tuple(float(known[a].mean()) if a.any() else 1.0 for a in accepted)
    return SecretModel(network, thresholds, kept)


def labelled_rows(docs: DataFrame, shards: int, each: int) -> DataFrame:
    """Every text's findings, as many planted ones and ``each`` at least: place, label, kind of
    context, and the symbols of each of its pieces."""
    key = F.xxhash64(F.lit(SEED), "doc_id", "text")

    def run(frames):
        for frame in frames:
            out = []
            for shard, key, text in zip(frame["shard"], frame["key"], frame["text"]):
                text = text if isinstance(text, str) else ""
                rng = np.random.default_rng([SEED, key & (1 << 64) - 1])
                rows, contexts, words = examples(text, rng)
                n = max(each, len(rows))
                rows += planted(contexts or [("", "")], words or WORDS, n, rng, int(rng.integers(2)))
                for i, ((w, label), held) in enumerate(zip(rows, rng.random(len(rows)) < HELD_OUT)):
                    seen = islice(pieces(*w), None if held else PIECES)
                    symbols = bytearray()
                    while some := list(islice(seen, 4096)):
                        symbols += encode(some).astype(np.uint8).tobytes()
                    out.append((shard, key, i, label, bool(held), named(w[0]), bytes(symbols)))
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    columns = ["shard", "key", "i", "label", "held", "named", "symbols"]
    keyed = docs.select(F.pmod(key, F.lit(shards)).alias("shard"), key.alias("key"), "text")
    return keyed.mapInPandas(run, "shard long, key long, i int, label int, held boolean, named int, symbols binary")


def train_round(rows: DataFrame, network: CharCNN, number: int) -> CharCNN:
    """The mean, by rows, of what the shards make of the network, each with all its rows."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "i"])
        symbols = [np.frombuffer(s, np.uint8).reshape(-1, LENGTH) for s in frame["symbols"]]
        labels = np.repeat(frame["label"].to_numpy(np.float32), [len(s) for s in symbols])
        own = CharCNN.of(network.parameters())
        rng = np.random.default_rng([SEED, number, int(frame["shard"].iloc[0])])
        own.fit(np.concatenate(symbols), labels, rng, max(1, ROUND_ROWS // len(labels)), RATES[number])
        return pd.DataFrame({"n": [len(labels)], "parameters": [own.parameters()]})

    fitted = spread(rows.where("NOT held"), "shard").groupBy("shard").applyInPandas(fit, "n long, parameters array<double>")
    each = fitted.select("n", F.posexplode("parameters").alias("at", "p"))
    sums = each.groupBy("at").agg(F.sum((F.col("p") * F.col("n") * FIXED).cast("long")).alias("p"), F.sum("n").alias("n"))
    mean = [r.p / r.n / FIXED for r in sums.orderBy("at").collect()]
    return CharCNN.of(mean) if mean else network


def calibrated(rows: DataFrame, network: CharCNN, recall: float) -> SecretModel:
    """Slope, shift and thresholds from all held-out findings, counted by kind of context, label and bin of the logit.

    A bin counts with the end that scores less, so that the recall is no lower than asked for.
    """

    def logits(frames):
        for frame in frames:
            symbols = [np.frombuffer(s, np.uint8).reshape(-1, LENGTH) for s in frame["symbols"]]
            if symbols:
                first = np.cumsum([0, *(len(s) for s in symbols[:-1])])
                best = np.maximum.reduceat(network.logits(np.concatenate(symbols)), first)
                yield frame[["named", "label"]].assign(bin=np.floor(best * BINS).astype(np.int64))

    bins = rows.where("held").mapInPandas(logits, "named int, label int, bin long").groupBy("named", "label", "bin").count()
    group, labels, at, n = np.array(sorted(map(tuple, bins.collect())), np.int64).reshape(-1, 4).T
    network.calibrate((at + 0.5) / BINS, labels, n)
    scores = np.minimum(network.probabilities(at / BINS), network.probabilities((at + 1) / BINS))
    thresholds, kept = [], []
    for g in (0, 1):
        own = group == g
        thresholds.append(recall_threshold(scores[own], labels[own], recall, n[own]))
        accepted = own & (scores >= thresholds[-1])
        kept.append(float(n[accepted] @ labels[accepted] / n[accepted].sum()) if accepted.any() else 1.0)
    return SecretModel(network, tuple(thresholds), tuple(kept))


def fit_model(docs: DataFrame, texts: int = TRAIN_TEXTS, rows: int = TRAIN_ROWS, recall: float = RECALL) -> SecretModel:
    """The network for this corpus, trained, calibrated and held to ``recall`` on every row's text.

    Rows are dealt to shards of about ``texts`` by a hash of id and text; at least ``rows`` findings are planted in
    all. Null and empty texts take planted findings without context. Without any row, planted ones alone are learnt from.
    What the driver sees is the shards' mean and counts by bin.
    """
    n = docs.count()
    if not n:
        return train([], rows, recall)
    labelled = cut_lineage(labelled_rows(docs, -(-n // texts), -(-rows // n)))
    network = CharCNN.fresh(np.random.default_rng(SEED))
    for number in range(len(RATES)):
        network = train_round(labelled, network, number)
    return calibrated(labelled, network, recall)


def scan(docs: DataFrame, model: SecretModel) -> DataFrame:
    """Each row's ``doc_id`` and ``findings``: kind, start, end (code points, end exclusive), score.

    Kinds ``assign``, ``access`` and ``hex`` come from the fixed patterns and are always kept;
    ``learned`` are further candidates that the network accepts: runs of ``LONG`` or more
    characters, or as long parts of runs beside fixed findings. All carry the network's
    probability. Findings are ordered by start, then kind. A null or empty text has none. Ids may
    be null or repeated; other columns are ignored. One pass, no shuffle.
    """
    order = {k: i for i, k in enumerate(KINDS)}

    def make():
        def run(texts: list) -> dict:
            spans, windows, owners = [], [], []
            for i, text in enumerate(texts):
                if not text:
                    continue
                base = base_spans(text)
                for kind, s, e in base + [("learned", s, e) for s, e in other_spans(text, base)]:
                    spans.append((kind, s, e))
                    windows.append(window(text, s, e))
                    owners.append(i)
            scores = model.score(windows)
            found: list[list] = [[] for _ in texts]
            for (kind, s, e), ok, p, i in zip(spans, model.accepts(windows, scores), scores, owners):
                if ok or kind != "learned":
                    found[i].append({"kind": kind, "start": s, "end": e, "score": float(p)})
            for f in found:
                f.sort(key=lambda x: (x["start"], order[x["kind"]]))
            return {"findings": found}

        return run

    return map_texts(docs, make, FIELDS)
