"""Gradient-boosted trees in numpy: fitted on binned statistics, flattened into node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in one set of arrays; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        return 1.0 / (1.0 + np.exp(-self.margin(x)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1 for each row: every row walks down all trees, level by level."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                low = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return total


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray,
    trees: int = 40,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    least_rows: int = 20,
    penalty: float = 1.0,
) -> Forest:
    """Logistic boosting.  monotone: -1, 0 or 1 for each column; -1 means that the score may not rise with it.

    A split of a constrained column must order its two values, and both sides
    then stay on their side of the middle, so the whole tree is monotonic.
    """
    n, columns = x.shape
    share = np.clip(y.mean() if n else 1.0, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots = []
    if not n:
        trees = 0
    edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, bins + 1)[1:-1])) for c in range(columns)] if n else []
    binned = [np.searchsorted(edges[c], x[:, c], side="left") for c in range(columns)] if n else []
    total = np.full(n, base)

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, left_depth: int, low: float, high: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        own = float(np.clip(-g / (h + penalty), low, high))
        at = len(nodes)
        nodes.append([0, 0.0, at, at, own * rate])
        if not left_depth or len(rows) < 2 * least_rows:
            return at
        best = (1e-6, -1, -1)
        for c in range(columns):
            if not len(edges[c]):
                continue
            size = len(edges[c]) + 1
            b = binned[c][rows]
            gs = np.cumsum(np.bincount(b, grad[rows], size))[:-1]
            hs = np.cumsum(np.bincount(b, hess[rows], size))[:-1]
            counts = np.cumsum(np.bincount(b, minlength=size))[:-1]
            gain = gs**2 / (hs + penalty) + (g - gs) ** 2 / (h - hs + penalty) - g**2 / (h + penalty)
            ok = (counts >= least_rows) & (len(rows) - counts >= least_rows)
            if monotone[c]:
                ok &= monotone[c] * (-(g - gs) / (h - hs + penalty) + gs / (hs + penalty)) >= 0
            gain = np.where(ok, gain, 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], c, k)
        _, c, k = best
        if c < 0:
            return at
        down = binned[c][rows] <= k
        bounds = ((low, high), (low, high))
        if monotone[c]:
            sides = [float(np.clip(-grad[r].sum() / (hess[r].sum() + penalty), low, high)) for r in (rows[down], rows[~down])]
            middle = (sides[0] + sides[1]) / 2
            bounds = ((low, middle), (middle, high)) if monotone[c] > 0 else ((middle, high), (low, middle))
        nodes[at][0], nodes[at][1] = c, edges[c][k]
        nodes[at][2] = grow(rows[down], grad, hess, left_depth - 1, *bounds[0])
        nodes[at][3] = grow(rows[~down], grad, hess, left_depth - 1, *bounds[1])
        return at

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), depth, -np.inf, np.inf))
        table = np.array(nodes)
        total = total + Forest(0.0, np.array([roots[-1]]), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], depth).margin(x)
    table = np.array(nodes) if nodes else np.zeros((0, 5))
    return Forest(base, np.array(roots, int), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], depth)
