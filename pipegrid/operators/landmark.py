"""Kernel methods: the machine and the Nystroem map through landmark rows, kernel PCA over all rows.

The landmarks are the training rows with the smallest hash, at most a fixed number, so
the kernel matrix the driver decomposes never grows with the data. With no more training
rows than landmarks the results are exact. Kernel PCA takes all rows whatever their number:
beyond a limit they stay on the executors (:mod:`pipegrid.operators.kernel_blocks`).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, Features, from_array
from pipegrid.functions.blocks import block_map
from pipegrid.functions.hashing import hash_bits
from pipegrid.operators import kernel_blocks
from pipegrid.operators.columns import clamp_negatives
from pipegrid.operators.linear import LinearModel, fit_squared_hinge
from pipegrid.operators.project import orient

SLICE_DOUBLES = 1_000_000  # kernel values that a worker holds at once, whatever a batch's length


def landmarks(train: Features, seed: int, limit: int) -> np.ndarray:
    rows = (
        train.with_array()
        .orderBy(hash_bits(f"landmark:{seed}:", F.col("row_id")), "row_id")
        .limit(limit)
        .select(ARRAY)
        .toArrow()
    )
    return np.array(rows.column(ARRAY).to_pylist(), dtype=float).reshape(-1, train.dim)


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    away = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * x @ y.T
    return np.exp(-gamma * np.maximum(away, 0.0))


@dataclass(frozen=True)
class KernelMap:
    """rbf(x, points), optionally double-centred, times a matrix."""

    points: np.ndarray
    weights: np.ndarray
    gamma: float
    column_means: np.ndarray | None = None
    grand_mean: float = 0.0
    clamp: bool = False

    def apply(self, features: Features) -> Features:
        source = clamp_negatives(features) if self.clamp else features
        points, weights, gamma = self.points, self.weights, self.gamma
        means, grand = self.column_means, self.grand_mean

        def mapped(x: np.ndarray) -> np.ndarray:
            out = np.empty((len(x), weights.shape[1]))
            step = max(1, SLICE_DOUBLES // max(1, len(points)))
            for start in range(0, len(x), step):
                k = rbf(x[start : start + step], points, gamma)
                if means is not None:
                    k = k - means - k.mean(axis=1, keepdims=True) + grand
                out[start : start + step] = k @ weights
            return out

        made = block_map(mapped, source.array(), source.dim)
        return from_array(source.df.select(*source.keys(), made.alias(ARRAY)), weights.shape[1])


def _inverse_root(kernel: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(kernel)
    return (vectors / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T


def fit_nystroem(train: Features, seed: int = 0, gamma: float = 1.0, components: int = 100) -> KernelMap:
    points = landmarks(clamp_negatives(train), seed, components)
    return KernelMap(points, _inverse_root(rbf(points, points, gamma)), gamma, clamp=True)


def fit_kernel_pca(
    train: Features, seed: int = 0, gamma: float = 0.1, components: int = 100, limit: int = 2000
) -> KernelMap | kernel_blocks.RowKernelMap:
    """The components of all training rows; the driver decomposes the kernel matrix of ``limit`` rows at most."""
    n = train.df.count()
    if n > limit:
        made = kernel_blocks.fit(train, n, partial(rbf, gamma=gamma), components, seed)
        if made is not None:
            return made
    points = landmarks(train, seed, limit)  # all rows, or any of rows that are all the same
    kernel = rbf(points, points, gamma)
    means, grand = kernel.mean(axis=0), kernel.mean()
    centred = kernel - means[None, :] - means[:, None] + grand
    values, vectors = np.linalg.eigh(centred)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    positive = values > max(values.max(), 0.0) * 1e-12
    values, vectors = values[positive], orient(vectors[:, positive])
    return KernelMap(points, vectors / np.sqrt(values), gamma, means, float(grand))


@dataclass(frozen=True)
class KernelClassifier:
    kernel: KernelMap
    linear: LinearModel

    def predict(self, features: Features) -> DataFrame:
        return self.linear.predict(self.kernel.apply(features))


def fit_kernel_svm(train: Features, seed: int = 0, gamma: float = 0.1, c: float = 1.0, limit: int = 300) -> KernelClassifier:
    """Squared-hinge machine on the landmark kernel map; nears the full machine as limit grows."""
    points = landmarks(train, seed, limit)
    kernel = KernelMap(points, _inverse_root(rbf(points, points, gamma)), gamma)
    return KernelClassifier(kernel, fit_squared_hinge(kernel.apply(train), seed, c))
