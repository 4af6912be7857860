"""Gradient-boosted trees for binary labels, in numpy, with a logistic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Trees:
    """Complete binary trees of one depth. Node i has children 2i+1 (value <= cut) and 2i+2."""

    depth: int = 3
    rounds: int = 40
    rate: float = 0.3
    l2: float = 1.0
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.base)
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 25), method="lower")) for c in x.T]
        for _ in range(self.rounds):
            p = _sigmoid(z)
            g, h = p - y, p * (1 - p)
            n = 2**self.depth - 1
            feature, cut = np.zeros(n, int), np.full(n, np.inf)
            node = np.zeros(len(y), int)
            for i in range(n):
                own = node == i
                if own.any():
                    feature[i], cut[i] = self._split(x[own], g[own], h[own], cuts)
                node[own] = np.where(x[own, feature[i]] <= cut[i], 2 * i + 1, 2 * i + 2)
            at = node - n
            leaf = -self.rate * np.bincount(at, g, n + 1) / (np.bincount(at, h, n + 1) + self.l2)
            z += leaf[at]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def _split(self, x, g, h, cuts) -> tuple[int, float]:
        score = lambda a, b: a * a / (b + self.l2)
        whole, best = score(g.sum(), h.sum()), (1e-9, 0, np.inf)
        for f, values in enumerate(cuts):
            below = x[:, f, None] <= values
            gl, hl = g @ below, h @ below
            gain = score(gl, hl) + score(g.sum() - gl, h.sum() - hl) - whole
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(values[k]))
        return best[1], best[2]

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(x[rows, f] <= cut[node], 2 * node + 1, 2 * node + 2)
            z += leaf[node - len(feature)]
        return z

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Platt scaling on rows that the trees haven't seen, by Newton steps."""
        z = self.margin(x)
        design, w = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(30):
            p = _sigmoid(design @ w)
            hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
            w -= np.linalg.solve(hessian, design.T @ (p - target))
        self.slope, self.shift = map(float, w)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(x) + self.shift)
