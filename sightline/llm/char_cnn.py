"""A small character convolutional network in numpy: embedding, one convolution, max pooling, logistic output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BEFORE, INSIDE, AFTER = 16, 40, 16
STEP = INSIDE // 2  # characters between pieces of a longer candidate
LENGTH = BEFORE + INSIDE + AFTER
# Symbols: printable ASCII by code, then white space, other letters, anything else, padding.
SPACE, LETTER, OTHER, PAD = 95, 96, 97, 98
SYMBOLS = 99
EMBED, WIDTH, FILTERS = 8, 5, 32


def symbol(c: str) -> int:
    code = ord(c)
    if 32 < code < 127:
        return code - 32
    return SPACE if c.isspace() else LETTER if c.isalpha() else OTHER


def pieces(before: str, inside: str, after: str) -> Iterator[tuple[str, str, str]]:
    """Overlapping pieces of a candidate, the last at its end, each with what stands around it."""
    last = len(inside) - INSIDE
    if last <= 0:
        yield before, inside, after
        return
    for at in (*range(0, last, STEP), last):
        end = at + INSIDE
        head = inside[at - BEFORE : at] if at >= BEFORE else (before + inside[:at])[-BEFORE:]
        yield head, inside[at:end], (inside[end : end + AFTER] + after)[:AFTER]


def encode(windows: list[tuple[str, str, str]]) -> np.ndarray:
    """Symbols of (text before, candidate, text after), each cut or padded to its width."""
    out = np.full((len(windows), LENGTH), PAD, np.int64)
    for row, (before, inside, after) in zip(out, windows):
        before, inside, after = before[-BEFORE:], inside[:INSIDE], after[:AFTER]
        row[BEFORE - len(before) : BEFORE] = [symbol(c) for c in before]
        row[BEFORE : BEFORE + len(inside)] = [symbol(c) for c in inside]
        row[BEFORE + INSIDE : BEFORE + INSIDE + len(after)] = [symbol(c) for c in after]
    return out


_IN = np.zeros((LENGTH, 1), np.float32)
_IN[BEFORE : BEFORE + INSIDE] = 1


@dataclass
class CharCNN:
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    calibration: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> CharCNN:
        normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        fan = WIDTH * (EMBED + 1)
        return cls(
            normal(SYMBOLS, EMBED) * 0.5, normal(fan, FILTERS) * np.float32(np.sqrt(2 / fan)),
            np.zeros(FILTERS, np.float32), normal(FILTERS) * 0.1, np.zeros(1, np.float32),
        )

    @classmethod
    def of(cls, parameters) -> CharCNN:
        """The network of ``parameters()``, uncalibrated."""
        shapes = ((SYMBOLS, EMBED), (WIDTH * (EMBED + 1), FILTERS), (FILTERS,), (FILTERS,), (1,))
        ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return cls(*(p.reshape(s) for p, s in zip(np.split(np.array(parameters, np.float32), ends), shapes)))

    def parameters(self) -> list[float]:
        return np.concatenate([p.ravel() for p in (self.embed, self.conv, self.bias, self.out, self.shift)]).astype(float).tolist()

    def _columns(self, symbols: np.ndarray) -> np.ndarray:
        """Every run of WIDTH embedded characters, laid side by side."""
        x = np.concatenate([self.embed[symbols], np.broadcast_to(_IN, (*symbols.shape, 1))], axis=2)
        runs = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)
        return runs.transpose(0, 1, 3, 2).reshape(len(symbols), LENGTH - WIDTH + 1, -1)

    def logits(self, symbols: np.ndarray) -> np.ndarray:
        if not len(symbols):
            return np.zeros(0)
        parts = []
        for i in range(0, len(symbols), 512):
            z = np.maximum(self._columns(symbols[i : i + 512]) @ self.conv + self.bias, 0).max(axis=1)
            parts.append(z @ self.out + self.shift)
        return np.concatenate(parts).astype(np.float64)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * logits + b, -40, 40)))

    def best_logits(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        """The greatest logit of each window's pieces, a bounded number of pieces at a time."""
        best = np.full(len(windows), -np.inf)
        held, owner = [], []

        def settle() -> None:
            np.maximum.at(best, owner, self.logits(encode(held)))
            held.clear()
            owner.clear()

        for i, w in enumerate(windows):
            for piece in pieces(*w):
                held.append(piece)
                owner.append(i)
                if len(held) == 8192:
                    settle()
        if held:
            settle()
        return best

    def fit(self, symbols: np.ndarray, labels: np.ndarray, rng: np.random.Generator, epochs: int = 10, rate: float = 3e-3) -> None:
        """Adam on the logistic loss."""
        params = [self.embed, self.conv, self.bias, self.out, self.shift]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(symbols))
            for i in range(0, len(order), 64):
                at = order[i : i + 64]
                step += 1
                for p, g, m, v in zip(params, self._gradients(symbols[at], labels[at]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, symbols: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        n = len(symbols)
        columns = self._columns(symbols)
        z = columns @ self.conv + self.bias
        top = z.argmax(axis=1)
        peak = np.take_along_axis(z, top[:, None, :], 1)[:, 0, :]
        pooled = np.maximum(peak, 0)
        error = ((1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -40, 40))) - labels) / n).astype(np.float32)
        to_peak = error[:, None] * self.out * (peak > 0)  # (n, filters)
        rows = np.arange(n)[:, None]
        seen = columns[rows, top]  # (n, filters, fan): what each filter's peak looked at
        d_conv = np.einsum("nf,nfk->kf", to_peak, seen)
        d_seen = (to_peak[:, :, None] * self.conv.T[None]).reshape(n, FILTERS, WIDTH, EMBED + 1)[..., :EMBED]
        d_embed = np.zeros_like(self.embed)
        where = symbols[rows[:, :, None], top[:, :, None] + np.arange(WIDTH)]
        np.add.at(d_embed, where.reshape(-1), d_seen.reshape(-1, EMBED))
        return [d_embed, d_conv, to_peak.sum(0), error @ pooled, error.sum(keepdims=True)]

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, counts: np.ndarray | float = 1.0) -> None:
        """Slope and shift that make the probabilities of held-out rows, each ``counts`` times, right (Newton steps)."""
        x, (a, b) = logits, (1.0, 0.0)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
            w = (p * (1 - p) + 1e-6) * counts
            off = (p - labels) * counts
            # A weak pull to the identity keeps separable data finite.
            g = np.array([(off * x).sum() + 0.1 * (a - 1), off.sum() + 0.1 * b])
            h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.calibration = (float(a), float(b))


def recall_threshold(scores: np.ndarray, labels: np.ndarray, recall: float, counts: np.ndarray | None = None) -> float:
    """Greatest threshold at which at least ``recall`` of the positives, each ``counts`` times, score as much or more."""
    own = labels > 0
    if not own.any():
        return 1.1
    order = np.argsort(scores[own], kind="stable")
    upto = np.cumsum(np.ones(len(order), np.int64) if counts is None else counts[own][order])
    below = min(int(upto[-1]) - 1, int(np.floor((1 - recall) * upto[-1] + 1e-9)))
    return float(scores[own][order][np.searchsorted(upto, below, "right")])
