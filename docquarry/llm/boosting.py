"""Gradient-boosted trees for a yes-or-no label: histogram splits, logistic loss, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Histogram bins of a feature, trees, splits above a leaf, and the usual shrinkage and leaf penalties.
BINS, TREES, DEPTH, RATE, PENALTY, LEAST = 48, 60, 3, 0.2, 1.0, 8


@dataclass
class Trees:
    """All trees in one set of arrays: node i asks feature[i] <= threshold[i] and goes to left[i] or right[i]; a leaf
    goes to itself and has value[i]. Tree t starts at root[t]."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log odds of each row: every row steps down every tree at once, DEPTH times."""
        at = np.broadcast_to(self.root, (len(x), len(self.root)))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)


def _leaf(g: float, h: float, low: float, high: float) -> float:
    return float(np.clip(-g / (h + PENALTY), low, high))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int]) -> Trees:
    """monotone: for each feature 1 (the score may not fall as it grows), -1 (may not rise) or 0.

    A split on a constrained feature must order its children's values, and bounds what lies below them by the middle of
    the two, so the whole tree keeps the order. Rows of one label only give a constant score."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        score = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            roots.append(_grow(np.arange(len(y)), binned, edges, g, h, monotone, -4.0, 4.0, DEPTH, nodes, score))
    if not roots:
        nodes, roots = [[0, np.inf, 0, 0, 0.0]], [0]
    f, t, left, right, v = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(f.astype(np.int64), t.astype(float), left.astype(np.int64), right.astype(np.int64), v.astype(float), np.array(roots), base)


def _grow(rows, binned, edges, g, h, monotone, low, high, depth, nodes, score) -> int:
    """Append the subtree of these rows to nodes and return its index; adds the leaves' values to score."""
    me = len(nodes)
    nodes.append([0, np.inf, me, me, 0.0])
    best = None
    if depth and len(rows) >= 2 * LEAST:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f, e in enumerate(edges):
            if not len(e):
                continue
            bins = binned[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(bins, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
            ok = (nl >= LEAST) & (len(rows) - nl >= LEAST)
            a, b = np.clip(-gl / (hl + PENALTY), low, high), np.clip(-(total_g - gl) / (total_h - hl + PENALTY), low, high)
            ok &= (monotone[f] * (b - a) >= 0) if monotone[f] else True
            gain = gl**2 / (hl + PENALTY) + (total_g - gl) ** 2 / (total_h - hl + PENALTY) - total_g**2 / (total_h + PENALTY)
            gain[~ok] = 0
            k = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k, a[k], b[k])
    if best is None:
        nodes[me][4] = RATE * _leaf(g[rows].sum(), h[rows].sum(), low, high)
        score[rows] += nodes[me][4]
        return me
    _, f, k, a, b = best
    goes, mid = binned[rows, f] <= k, (a + b) / 2
    bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[monotone[f]]
    kids = [_grow(rows[side], binned, edges, g, h, monotone, *bound, depth - 1, nodes, score) for side, bound in ((goes, bounds[0]), (~goes, bounds[1]))]
    nodes[me][:4] = [f, float(edges[f][k]), *kids]
    return me
