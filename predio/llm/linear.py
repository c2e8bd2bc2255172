"""Sparse logistic regression on bounded samples, and hashed text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np


def _narrowest(n: int) -> type:
    """What holds the numbers below ``n``."""
    return np.uint16 if n <= 1 << 16 else np.int32


@dataclass
class Sparse:
    """Rows of feature numbers, one after the other; their values are 1 unless given."""

    edges: np.ndarray
    index: np.ndarray
    value: np.ndarray | None = None

    def __post_init__(self) -> None:
        counts = np.diff(self.edges)
        self._full = np.flatnonzero(counts)
        rows = np.repeat(np.arange(len(counts), dtype=_narrowest(len(counts))), counts)
        top = int(self.index.max()) + 1 if len(self.index) else 0
        parts = []
        for low in range(0, top, step := top // 16 + 1):  # a sixteenth of the features at a time, as places take 8 bytes each
            at = np.flatnonzero((self.index >= low) & (self.index < low + step)).astype(np.int32)
            at = at[np.argsort(self.index[at], kind="stable")]
            own = self.index[at]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
            parts.append((rows[at], own[first], first, at if self.value is not None else at[:0]))
        joined = [np.concatenate(c) if c else np.empty(0, np.int64) for c in zip(*parts, strict=True)] or [np.empty(0, np.int64)] * 4
        before = np.cumsum([0, *(len(p[0]) for p in parts)])
        self._row, self._feature = joined[0], joined[1].astype(np.int64)
        self._first = np.concatenate([p[2] + n for p, n in zip(parts, before, strict=False)]) if parts else np.empty(0, np.int64)
        self._order = None if self.value is None else joined[3]

    @classmethod
    def of(cls, rows: list[np.ndarray], values: list[np.ndarray] | None = None) -> Sparse:
        edges = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        index = np.concatenate(rows) if rows else np.empty(0, np.int32)
        index = index.astype(_narrowest(int(index.max()) + 1 if len(index) else 0), copy=False)
        return cls(edges, index, np.concatenate(values).astype(np.float64) if values else None)

    def dot(self, w: np.ndarray) -> np.ndarray:
        """The sum of each row's weights."""
        out = np.zeros(len(self.edges) - 1)
        for rows, own, first in _runs(self._full, self.edges[self._full], len(self.index)):
            each = w[self.index[own]] if self.value is None else self.value[own] * w[self.index[own]]
            out[rows] = np.add.reduceat(each, first)
        return out

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        """The sum over rows of ``g`` for each feature."""
        out = np.zeros(size)
        for features, own, first in _runs(self._feature, self._first, len(self.index)):
            each = g[self._row[own]] if self._order is None else self.value[self._order[own]] * g[self._row[own]]
            out[features] = np.add.reduceat(each, first)
        return out


#: Entries that are summed at a time, so that a product of all of them never stands in memory.
RUN = 1 << 18


def _runs(names: np.ndarray, first: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    """Whole segments (names, their entries, where each begins among these) of about ``RUN`` entries; a longer segment stays whole."""
    at = 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(first, first[at] + RUN)))
        end = int(first[stop]) if stop < len(first) else n
        yield names[at:stop], slice(int(first[at]), end), first[at:stop] - first[at]
        at = stop


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Linear:
    weight: np.ndarray
    bias: float = 0.0
    scale: float = field(default=1.0)
    shift: float = field(default=0.0)

    def logit(self, x: Sparse) -> np.ndarray:
        return x.dot(self.weight) + self.bias

    def calibrated(self, x: Sparse) -> np.ndarray:
        return self.scale * self.logit(x) + self.shift


def fit(x: Sparse, y: np.ndarray, size: int, *, l2: float = 1e-4, steps: int = 300, rate: float = 0.1, swaps: Sparse | None = None, swap_penalty: float = 0.0, row_weight: np.ndarray | None = None) -> Linear:
    """Logistic regression by Adam on the mean loss.

    ``swaps`` holds, for each counterfactual, the features of the original
    less those of the swapped text; the penalty is the mean square of the
    score difference they make.
    """
    model = Linear(np.zeros(size))
    n = max(1, len(y))
    row_weight = np.ones(len(y)) if row_weight is None else row_weight
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        g = (sigmoid(model.logit(x)) - y) * row_weight / n
        grad = x.back(g, size) + l2 * model.weight
        if swaps is not None and len(swaps.edges) > 1 and swap_penalty:
            d = swaps.dot(model.weight)
            grad += swap_penalty * 2 * swaps.back(d / len(d), size)
        grad = np.append(grad, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        model.weight -= step[:-1]
        model.bias -= step[-1]
    return model


def calibrate(model: Linear, x: Sparse, y: np.ndarray) -> Linear:
    """Set scale and shift of the scores by a logistic fit of one variable on other rows (Platt)."""
    z = model.logit(x)
    target = (y * (y.sum() + 1) + (1 - y)) / np.where(y > 0, y.sum() + 2, (1 - y).sum() + 2)  # smoothed labels
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        w, r = p * (1 - p) + 1e-9, p - target
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [(r * z).sum() + 1e-6 * a, r.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    model.scale, model.shift = max(a, 1e-3), b
    return model
