"""Gradient-boosted trees for two classes, on a bounded sample: histogram splits, logistic loss, and a calibration
of the scores on a holdout. Small enough to travel to the workers inside a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Booster:
    feature: np.ndarray  # trees x inner nodes; complete trees of one depth
    cut: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float
    slope: float = 1.0
    shift: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds before calibration."""
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.score(x) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Booster:
    """Deterministic: no row or column is drawn at random. With one class only, the score is constant."""
    n, width = x.shape
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base, inner = float(np.log(share / (1 - share))), (1 << depth) - 1
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if n else np.zeros((0, width), int)
    score = np.full(n, base)
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = _sigmoid(score)
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            if len(at) > 1:
                g, h = gradient[at], weight[at]
                best = (1e-9, 0, np.inf)
                total_g, total_h = g.sum(), h.sum()
                for f in range(width):
                    if not len(edges[f]):
                        continue
                    left_g = np.cumsum(np.bincount(bins[at, f], g, len(edges[f]) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(bins[at, f], h, len(edges[f]) + 1))[:-1]
                    gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), f, float(edges[f][i]))
                feature[k], cut[k] = best[1], best[2]
            node[at] = 2 * k + 1 + (x[at, feature[k]] > cut[k])
        leaf = node - inner
        value = rate * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, weight, inner + 1) + ridge)
        score += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Booster(np.array(features), np.array(cuts), np.array(values), base)


def calibrated(model: Booster, x: np.ndarray, y: np.ndarray, rounds: int = 200) -> Booster:
    """Fits slope and shift of the score on a holdout by damped Newton steps; the slope is kept positive and both
    are drawn lightly towards the identity, so that a small, separable holdout doesn't run off."""
    s = model.score(x)
    scale = max(1.0, float(np.abs(s).max(initial=1.0)))
    a, b, prior = 1.0, 0.0, 2.0
    for _ in range(rounds):
        p = _sigmoid(a * s + b)
        w = p * (1 - p)
        ga, gb = float(((y - p) * s).sum()) - prior * scale * (a - 1), float((y - p).sum()) - prior * b
        h = np.array([[float((w * s * s).sum()) + prior * scale, float((w * s).sum())], [float((w * s).sum()), float(w.sum()) + prior]])
        da, db = np.linalg.solve(h, np.array([ga, gb]))
        a, b = max(0.05, a + 0.5 * da), b + 0.5 * db
    return Booster(model.feature, model.cut, model.value, model.base, float(a), float(b))
