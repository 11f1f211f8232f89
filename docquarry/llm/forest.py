"""Random forests for a yes-or-no label, fitted as nested nodes and written out as a SQL expression over arrays of nodes."""

from __future__ import annotations

import numpy as np

TREES, DEPTH, LEAST = 24, 8, 3

#: A leaf's share of positive rows, or feature, cut, the node for values up to the cut, and the node for others.
Node = float | tuple


def _tree(x: np.ndarray, y: np.ndarray, names: list[str], depth: int, rng: np.random.Generator) -> Node:
    """The node of these rows."""
    p = float(y.mean())
    if depth and len(y) >= 2 * LEAST and 0 < p < 1:
        best = (1e-9, None)
        for f in rng.choice(len(names), size=max(2, int(np.sqrt(len(names)))), replace=False):
            v = np.unique(x[:, f])
            if len(v) < 2:
                continue
            cuts = (v[:-1] + v[1:]) / 2
            cuts = cuts if len(cuts) <= 24 else cuts[np.linspace(0, len(cuts) - 1, 24).astype(int)]
            left = x[:, f][:, None] <= cuts
            n, pos = left.sum(axis=0), (left & (y[:, None] > 0)).sum(axis=0)
            m, q = len(y) - n, y.sum() - pos
            ok = (n >= LEAST) & (m >= LEAST)
            gini = np.where(ok, pos * (n - pos) / np.maximum(n, 1) + q * (m - q) / np.maximum(m, 1), np.inf)
            k = int(np.argmin(gini))
            gain = len(y) * p * (1 - p) - gini[k]
            if gain > best[0]:
                best = (gain, (f, float(cuts[k]), left[:, k]))
        if best[1]:
            f, cut, goes = best[1]
            return (names[f], cut, *(_tree(x[s], y[s], names, depth - 1, rng) for s in (goes, ~goes)))
    return round(p, 6)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> list[Node]:
    """TREES trees, each fitted to a bootstrap sample with a few features a split."""
    rng = np.random.default_rng(seed)
    samples = (rng.integers(0, len(y), len(y)) for _ in range(TREES))
    return [_tree(x[rows], y[rows], names, DEPTH, rng) for rows in samples]


def _flat(node: Node, names: list[str]) -> tuple[list[int], list[float], list[float]]:
    """A tree as one of DEPTH full levels, level by level: each node's feature and cut, and the leaves. Below a leaf of fewer
    levels all leaves are that one."""
    level, features, cuts = [node], [], []
    for _ in range(DEPTH):
        inner = [n if isinstance(n, tuple) else (names[0], 0.0, n, n) for n in level]
        features += [names.index(n[0]) for n in inner]
        cuts += [n[1] for n in inner]
        level = [side for n in inner for side in n[2:]]
    return features, cuts, level


def to_sql(trees: list[Node], names: list[str], ref: str = "") -> str:
    """A SQL expression of the trees' mean; names: the features, ref: what stands before a feature's name.

    The nodes of all trees are three constant arrays that a fold walks level by level, so the expression is as small for
    deep trees as for flat ones, and the driver doesn't hold each branch as expressions of its own."""
    features, cuts, leaves = ([x for t in trees for x in _flat(t, names)[i]] for i in range(3))
    array = lambda values, kind: f"CAST(split('{','.join(values)}', ',') AS ARRAY<{kind}>)"
    inner, at = 2**DEPTH - 1, f"q__t * {2**DEPTH - 1} + q__n"
    step = f"2 * q__n + IF(q__x[{array(map(str, features), 'INT')}[{at}]] <= {array(map(repr, cuts), 'DOUBLE')}[{at}], 1, 2)"
    leaf = f"aggregate(sequence(1, {DEPTH}), 0, (q__n, q__d) -> {step}) - {inner}"
    total = f"aggregate(sequence(0, {len(trees) - 1}), 0.0D, (q__s, q__t) -> q__s + {array((f'{v:.6f}' for v in leaves), 'DOUBLE')}[q__t * {inner + 1} + {leaf}])"
    values = ", ".join(f"CAST({ref}{n} AS DOUBLE)" for n in names)
    return f"(transform(array(array({values})), q__x -> {total})[0] / {len(trees)}D)"
