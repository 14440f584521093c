"""Linear and quadratic discriminants from per-class scatter matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from pipegrid.frame import Features
from pipegrid.functions.blocks import block_score
from pipegrid.operators.bayes import predict_by_scores
from pipegrid.operators.class_stats import class_scatter


@dataclass(frozen=True)
class LinearDiscriminant:
    classes: tuple[int, ...]
    coefficients: np.ndarray
    intercepts: np.ndarray

    def predict(self, features: Features) -> DataFrame:
        coefficients, intercepts = self.coefficients, self.intercepts

        def expression(elements, i):
            from pyspark.sql import functions as F

            total = F.lit(float(intercepts[i]))
            for e, w in zip(elements, coefficients[i]):
                total = total + e * F.lit(float(w))
            return total

        return predict_by_scores(features, self.classes, expression, lambda x: x @ coefficients.T + intercepts)


def fit_lda(train: Features, seed: int = 0, tolerance: float = 0.1) -> LinearDiscriminant:
    """Pooled within-class scatter, with directions of tiny spread cut off by ``tolerance``."""
    classes, counts, means, scatter = class_scatter(train)
    n, k = counts.sum(), len(classes)
    priors = counts / n
    grand = priors @ means
    pooled = scatter.sum(axis=0)
    spread = np.sqrt(np.diag(pooled) / n)
    spread[spread == 0] = 1.0
    standard = pooled / np.outer(spread, spread) / (n - k)
    values, vectors = np.linalg.eigh(standard)
    size = np.sqrt(np.maximum(values[::-1], 0.0))
    kept = size > tolerance
    whiten = (vectors[:, ::-1][:, kept] / spread[:, None]) / size[kept]
    between = np.sqrt(n * priors / (k - 1))[:, None] * (means - grand) @ whiten
    _, size, axes = np.linalg.svd(between, full_matrices=False)
    rank = int((size > tolerance * size[0]).sum())
    whiten = whiten @ axes.T[:, :rank]
    centred = (means - grand) @ whiten
    coefficients = centred @ whiten.T
    intercepts = -0.5 * (centred * centred).sum(axis=1) + np.log(priors) - coefficients @ grand
    return LinearDiscriminant(tuple(classes), coefficients, intercepts)


@dataclass(frozen=True)
class QuadraticDiscriminant:
    classes: tuple[int, ...]
    means: np.ndarray
    whiten: tuple[np.ndarray, ...]
    constants: np.ndarray

    def predict(self, features: Features) -> DataFrame:
        means, whiten, constants = self.means, self.whiten, self.constants
        table = np.array(self.classes, dtype=float)

        def choose(x):
            scores = np.stack(
                [c - 0.5 * (((x - m) @ w) ** 2).sum(axis=1) for m, w, c in zip(means, whiten, constants)], axis=1
            )
            return table[scores.argmax(axis=1)]

        chosen = block_score(choose, features.array(), features.dim).cast("int")
        return features.df.select(*features.keys(), chosen.alias("y_pred"))


def fit_qda(train: Features, seed: int = 0) -> QuadraticDiscriminant:
    """A covariance per class (n - 1 divisor); directions without any spread are left out."""
    classes, counts, means, scatter = class_scatter(train)
    if (counts < 2).any():
        raise ValueError("each class needs at least two rows")
    whiten, constants = [], []
    for count, s in zip(counts, scatter):
        values, vectors = np.linalg.eigh(s / (count - 1))
        kept = values > values.max() * 1e-12
        if not kept.any():
            raise ValueError("a class has no spread at all")
        whiten.append(vectors[:, kept] / np.sqrt(values[kept]))
        constants.append(np.log(count / counts.sum()) - 0.5 * np.log(values[kept]).sum())
    return QuadraticDiscriminant(tuple(classes), means, tuple(whiten), np.array(constants))
