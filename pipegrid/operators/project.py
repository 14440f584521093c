"""Linear projections: principal components, independent components, merged columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, Features, from_array
from pipegrid.functions.blocks import block_map, partial_sums
from pipegrid.functions.hashing import local_normal
from pipegrid.operators.class_stats import column_means, gram
from pipegrid.session import hold


@dataclass(frozen=True)
class Projection:
    """(x - center) @ weights; the matrix is model-sized."""

    center: np.ndarray
    weights: np.ndarray

    def apply(self, features: Features) -> Features:
        center, weights = self.center, self.weights
        moved = block_map(lambda x: (x - center) @ weights, features.array(), features.dim)
        return from_array(features.df.select(*features.keys(), moved.alias(ARRAY)), weights.shape[1])


def orient(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest loading positive."""
    largest = np.abs(vectors).argmax(axis=0)
    signs = np.sign(vectors[largest, np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1.0, signs)


def fit_pca(train: Features, seed: int = 0, share: float = 0.9999) -> Projection:
    """The fewest components whose variance share exceeds ``share``; two passes over the rows."""
    n, mean = column_means(train)
    covariance = gram(train, mean) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    total = values.sum()
    kept = len(values)
    if total > 0:
        kept = min(int(np.searchsorted(np.cumsum(values / total), share, side="right")) + 1, len(values))
    return Projection(mean, orient(vectors[:, :kept]))


def _decorrelate(w: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(w @ w.T)
    values = np.maximum(values, np.finfo(float).tiny)
    return (vectors / np.sqrt(values)) @ vectors.T @ w


def fit_ica(train: Features, seed: int = 0, iterations: int = 200, tolerance: float = 1e-4) -> Projection:
    """Parallel fixed-point iteration with the log-cosh contrast, on unwhitened data.

    Each iteration is one pass that sums two d x d statistics over a cached copy of the
    arrays, whose partitions are known: few of them need no merge and no shuffle.
    """
    d = train.dim
    w = _decorrelate(
        np.array([[local_normal(f"ica:{seed}:", f"{i}:{j}") for j in range(d)] for i in range(d)])
    )
    rows = hold(train.with_array())
    try:
        for _ in range(iterations):

            def contrast(data, w=w):
                moved = np.tanh(data[ARRAY] @ w.T)
                slope = (1.0 - moved * moved).sum(axis=0)
                return np.concatenate([(moved.T @ data[ARRAY]).reshape(-1), slope, [len(moved)]])

            total = partial_sums(rows, {ARRAY: d}, [], contrast, d * d + d + 1)
            n = total[-1]
            step = total[: d * d].reshape(d, d) / n - (total[d * d : -1] / n)[:, None] * w
            moved = _decorrelate(step)
            change = np.abs(np.abs((moved * w).sum(axis=1)) - 1.0).max()
            w = moved
            if change < tolerance:
                break
    finally:
        rows.unpersist()
    return Projection(np.zeros(d), w.T)


@dataclass(frozen=True)
class ColumnGroups:
    """Mean of the columns in each group."""

    groups: tuple[tuple[int, ...], ...]

    def apply(self, features: Features) -> Features:
        e = features.elements()
        pooled = []
        for members in self.groups:
            total = e[members[0]]
            for j in members[1:]:
                total = total + e[j]
            pooled.append(total / F.lit(float(len(members))))
        return features.replace_elements(pooled, [f"g_{i}" for i in range(len(pooled))])


def fit_agglomeration(train: Features, seed: int = 0, clusters: int = 25) -> ColumnGroups:
    """Ward merging of columns; one Gram pass gives all distances between columns."""
    d = train.dim
    products = gram(train)
    squares = np.diag(products)
    away = np.maximum(squares[:, None] + squares[None, :] - 2.0 * products, 0.0)
    np.fill_diagonal(away, np.inf)
    members = {j: [j] for j in range(d)}
    alive = list(range(d))
    while len(alive) > min(clusters, d):
        table = away[np.ix_(alive, alive)]
        flat = int(table.argmin())
        a, b = sorted((alive[flat // len(alive)], alive[flat % len(alive)]))
        na, nb = len(members[a]), len(members[b])
        for c in alive:
            if c in (a, b):
                continue
            nc = len(members[c])
            merged = ((na + nc) * away[a, c] + (nb + nc) * away[b, c] - nc * away[a, b]) / (na + nb + nc)
            away[a, c] = away[c, a] = merged
        members[a] = sorted(members[a] + members.pop(b))
        alive.remove(b)
    return ColumnGroups(tuple(tuple(members[a]) for a in sorted(alive, key=lambda a: members[a][0])))
