"""Hashed character n-grams and linear classifiers trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

#: Characters of a text that are hashed at once.
CHUNK = 1 << 18


def hashed_grams(text: str, sizes: Sequence[int], bits: int) -> Iterator:
    """Arrays of bucket numbers, one for each n-gram of the lower-cased text between two spaces.

    A long text comes in chunks that overlap, so that every n-gram comes exactly once.
    """
    import numpy as np

    longest, text = max(sizes), f" {text.lower()} "
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK + longest - 1].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        for n in sizes:
            count = min(CHUNK, len(points) - n + 1)
            if count <= 0:
                continue
            h = np.full(count, n, np.uint64)
            for j in range(n):
                h ^= points[j : j + count]
                h *= np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            yield (h >> np.uint64(64 - bits)).astype(np.int64) if bits <= 32 else h


def counts(text: str | None, sizes: Sequence[int], bits: int):
    """Bucket numbers of a text, ascending, and how often each occurs."""
    import numpy as np

    total = np.zeros(1 << bits, np.int64)
    for part in hashed_grams(text or "", sizes, bits):
        total += np.bincount(part, minlength=1 << bits)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass(frozen=True)
class Ftrl:
    """FTRL-proximal with an elastic net, for multinomial logistic regression on sparse rows."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.01
    epochs: int = 6

    def fit(self, rows: Sequence[tuple], labels: Sequence[int], classes: int, features: int):
        """Weights (features + 1, classes); the last row is the intercept, which is not penalised.

        Rows are (ascending feature numbers, values) and are visited in the given order.
        """
        import numpy as np

        z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
        eye = np.eye(classes)
        bias = np.array([features])

        def lead(at):
            zi, ni = z[at], n[at]
            l1 = np.where(at == features, 0.0, self.l1)[:, None]
            l2 = np.where(at == features, 0.0, self.l2)[:, None]
            w = (np.sign(zi) * l1 - zi) / ((self.beta + np.sqrt(ni)) / self.alpha + l2)
            w[np.abs(zi) <= l1] = 0.0
            return w

        for _ in range(self.epochs):
            for (at, values), label in zip(rows, labels, strict=True):
                at, x = np.concatenate([at, bias]), np.append(values, 1.0)
                w = lead(at)
                score = x @ w
                p = np.exp(score - score.max())
                p /= p.sum()
                g = x[:, None] * (p - eye[label])[None, :]
                ni = n[at]
                sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / self.alpha
                z[at] += g - sigma * w
                n[at] = ni + g * g
        return np.vstack([lead(np.arange(features)), lead(bias)])


def softmax(scores, temperature: float = 1.0):
    import numpy as np

    s = scores / temperature
    s = s - s.max(axis=-1, keepdims=True)
    e = np.exp(s)
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores, labels) -> float:
    """The temperature of least log loss, by golden section between 1/20 and 20."""
    import numpy as np

    if not len(labels):
        return 1.0
    at = np.arange(len(labels))

    def loss(log_t: float) -> float:
        return float(-np.log(softmax(scores, np.exp(log_t))[at, labels] + 1e-12).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = loss(a), loss(b)
    for _ in range(40):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = loss(b)
    return float(np.exp((low + high) / 2))
