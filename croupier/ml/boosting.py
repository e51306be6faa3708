"""Boosted regression trees for one short series (a few thousand rows), in numpy.

Spark deals out the series and holds the models; this is what a task does with one of them. Squared
loss, histogram splits, leaves grown best gain first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# ---- fixed values ------------------------------------------------------------------
ROUNDS, RATE, LEAVES, L2, LEAST_ROWS, BINS = 90, 0.09, 18, 1.2, 20, 255
# ------------------------------------------------------------------------------------


@dataclass
class Trees:
    """All trees as one list of nodes; a leaf is its own child. ``roots`` are the first nodes."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                further = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
                if (further == node).all():
                    break
                node = further
            out += self.value[node]
        return out


def _edges(column: np.ndarray) -> np.ndarray:
    """Thresholds between the distinct values of a column, at most ``BINS - 1`` of them."""
    values = np.unique(column)
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < BINS:
        return middle
    return np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="midpoint"))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, leaves: int = LEAVES, l2: float = L2,
          least: int = LEAST_ROWS) -> Trees:
    edges = [_edges(x[:, j]) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = max(len(e) for e in edges) + 1
    flat = binned + np.arange(x.shape[1]) * width
    base = float(y.mean())
    fitted = np.full(len(y), base)
    roots: list[int] = []
    nodes: list[list] = []  # feature, threshold, left, right, value

    def best(rows: np.ndarray, gap: np.ndarray):
        """(gain, feature, bin) of the best split of some rows."""
        cells = flat[rows].ravel()
        total = np.bincount(cells, np.repeat(gap[rows], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(axis=1)
        count = np.bincount(cells, minlength=x.shape[1] * width).reshape(-1, width).cumsum(axis=1)
        n, g = len(rows), total[0, -1]
        gain = total**2 / (count + l2) + (g - total) ** 2 / (n - count + l2) - g**2 / (n + l2)
        gain[(count < least) | (n - count < least)] = -np.inf
        at = int(gain.argmax())
        return float(gain.flat[at]), at // width, at % width

    for _ in range(rounds):
        gap = y - fitted
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        everything = np.arange(len(y))
        grown = [(roots[-1], everything, *best(everything, gap))]
        while len(grown) < leaves:
            pick = max(range(len(grown)), key=lambda i: grown[i][2])
            node, rows, gain, feature, cut = grown[pick]
            if not gain > 1e-12:
                break
            low = binned[rows, feature] <= cut
            left, right = len(nodes), len(nodes) + 1
            nodes[node][:4] = [feature, float(edges[feature][cut]), left, right]
            nodes += [[0, 0.0, left, left, 0.0], [0, 0.0, right, right, 0.0]]
            grown[pick:pick + 1] = [(child, own, *best(own, gap)) for child, own in ((left, rows[low]), (right, rows[~low]))]
        for node, rows, *_ in grown:
            nodes[node][4] = rate * float(gap[rows].sum()) / (len(rows) + l2)
            fitted[rows] += nodes[node][4]
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
    return Trees(base, np.array(roots), feature, threshold, left, right, value)
