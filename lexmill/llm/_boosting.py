"""Histogram gradient-boosted trees in numpy, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row: all trees are walked at once, a level at a time."""
        if not len(x):
            return np.empty(0)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[row, self.feature[node]] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: int | None = None) -> Trees:
    """Boosted trees for the logistic loss; each split is the best over histograms of gradients.

    A leaf has at least `least` rows: by default 20, and fewer down to 2 when there are few rows. With no
    rows, or rows of one class, the score is the smoothed share of class 1 everywhere.
    """
    prior = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    if not 0 < y.sum() < len(y):
        return Trees(base, np.zeros(0, np.int32), *(np.zeros(1, np.int32), np.zeros(1), np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1)), 0)
    n, width = x.shape
    least = least or min(20, max(2, n // 200))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)  # bin b: edges[b - 1] < value <= edges[b]
    flat = code + np.arange(width) * bins
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots, margin = [], np.full(n, base)

    def add(value: float) -> int:
        at = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", at), ("right", at), ("value", value)):
            nodes[k].append(v)
        return at

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        leaf = lambda rows: -rate * grad[rows].sum() / (hess[rows].sum() + l2)  # noqa: E731,B023
        root = add(leaf(np.arange(n)))
        roots.append(root)
        level = [(root, np.arange(n))]
        for _ in range(depth):
            below = []
            for at, rows in level:
                if len(rows) < 2 * least:
                    continue
                cells = flat[rows].ravel()
                g, h, c = (np.bincount(cells, w, width * bins).reshape(width, bins).cumsum(axis=1) for w in (np.repeat(grad[rows], width), np.repeat(hess[rows], width), None))
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
                gain[(c < least) | (ct - c < least)] = -1
                f, b = divmod(int(gain.argmax()), bins)
                if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                    continue
                goes = code[rows, f] <= b
                parts = rows[goes], rows[~goes]
                kids = [add(leaf(r)) for r in parts]
                nodes["feature"][at], nodes["threshold"][at], nodes["left"][at], nodes["right"][at] = f, float(edges[f][b]), *kids
                below += zip(kids, parts, strict=True)
            level = below
        tree = Trees(0.0, np.array([root]), *_arrays(nodes), depth)
        margin += _raw(tree, x)
    return Trees(base, np.array(roots), *_arrays(nodes), depth)


def _arrays(nodes: dict[str, list]) -> tuple[np.ndarray, ...]:
    return np.array(nodes["feature"]), np.array(nodes["threshold"]), np.array(nodes["left"]), np.array(nodes["right"]), np.array(nodes["value"])


def _raw(tree: Trees, x: np.ndarray) -> np.ndarray:
    node, row = np.full(len(x), tree.roots[0]), np.arange(len(x))
    for _ in range(tree.depth):
        node = np.where(x[row, tree.feature[node]] <= tree.threshold[node], tree.left[node], tree.right[node])
    return tree.value[node]
