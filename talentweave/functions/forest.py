"""A small calibrated ensemble of classification trees, fitted with numpy on the driver.

It serves operators whose training sample is bounded by a parameter; the fitted arrays are a
few kilobytes, so that they travel with the task closure.
"""

from __future__ import annotations

import numpy as np


class Forest:
    """Bagged histogram trees; the top class gets a confidence from isotonic calibration."""

    def __init__(self, trees: int = 24, depth: int = 7, bins: int = 32, least: int = 4, seed: int = 7) -> None:
        self.trees, self.depth, self.bins, self.least, self.seed = trees, depth, bins, least, seed
        self.classes = 0
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int, groups: np.ndarray | None = None) -> Forest:
        """Three quarters of the groups grow the trees, the rest calibrate them; without ``groups`` a row is
        a group of its own. Rows of one group are never on both sides."""
        self.classes = classes
        rng = np.random.default_rng(self.seed)
        names, which = np.unique(np.arange(len(y)) if groups is None else groups, return_inverse=True)
        apart = np.zeros(len(names), bool)
        apart[rng.permutation(len(names))[: len(names) // 4]] = True
        held, own = np.flatnonzero(apart[which]), np.flatnonzero(~apart[which])
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        for _ in range(self.trees):
            pick = rng.choice(own, len(own))
            self.model.append(self._grow(x[pick], y[pick], edges, rng))
        p = self._raw(x[held])
        self.steps = _isotonic(p.max(1), (p.argmax(1) == y[held]).astype(float))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, edges: list[np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut = np.full(nodes, -1), np.zeros(nodes)
        share = np.full((nodes, self.classes), 1 / self.classes)
        at: dict[int, np.ndarray] = {0: np.arange(len(y))}
        wanted = min(x.shape[1], max(2, int(np.ceil(x.shape[1] * 0.6))))
        for node in range(nodes):
            rows = at.pop(node, None)
            if rows is None or not len(rows):
                continue
            counts = np.bincount(y[rows], minlength=self.classes)
            share[node] = (counts + 0.05) / (counts.sum() + 0.05 * self.classes)
            if 2 * node + 2 >= nodes or len(rows) < 2 * self.least or counts.max() == len(rows):
                continue
            best, own = 1e-9, _gini(counts[None, :])[0] * len(rows)
            for f in rng.choice(x.shape[1], wanted, replace=False):
                if not len(edges[f]):
                    continue
                bins = np.searchsorted(edges[f], x[rows, f])
                table = np.bincount(bins * self.classes + y[rows], minlength=(len(edges[f]) + 1) * self.classes).reshape(-1, self.classes)
                left = table.cumsum(0)[:-1]
                right = counts - left
                a, b = left.sum(1), right.sum(1)
                gain = np.where((a >= self.least) & (b >= self.least), own - _gini(left) * a - _gini(right) * b, 0)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[node], cut[node] = gain[k], f, edges[f][k]
            if feature[node] >= 0:
                goes = x[rows, feature[node]] > cut[node]
                at[2 * node + 1], at[2 * node + 2] = rows[~goes], rows[goes]
        return feature, cut, share

    def _raw(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), self.classes))
        rows = np.arange(len(x))
        for feature, cut, share in self.model:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]), node)
            total += share[node]
        return total / max(1, len(self.model))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and calibrated confidence of each row."""
        if not len(x):
            return np.zeros(0, int), np.zeros(0)
        p = self._raw(x)
        return p.argmax(1), np.interp(p.max(1), *self.steps)


def _gini(counts: np.ndarray) -> np.ndarray:
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    return 1 - ((counts / total) ** 2).sum(1)


def _isotonic(score: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising map from score to share of hits."""
    if not len(score):
        return np.array([0.0, 1.0]), np.array([0.0, 0.0])
    pools: list[list[float]] = []
    for s, h in sorted(zip(score.tolist(), hit.tolist(), strict=True)):
        pools.append([s, h, 1.0])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            s2, h2, n2 = pools.pop()
            s1, h1, n1 = pools.pop()
            pools.append([(s1 * n1 + s2 * n2) / (n1 + n2), (h1 * n1 + h2 * n2) / (n1 + n2), n1 + n2])
    return np.array([p[0] for p in pools]), np.array([p[1] * p[2] / (p[2] + 1) for p in pools])
