"""Naive Bayes classifiers. Ties go to the smallest class."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, WIDE_LIMIT, Features
from pipegrid.functions.blocks import block_score
from pipegrid.operators.class_stats import class_moments, class_sums
from pipegrid.operators.columns import clamp_negatives


def predict_by_scores(features: Features, classes, expression, block) -> DataFrame:
    """The class with the largest score.

    ``expression(elements, i)`` is the score of class i as a column for narrow data;
    ``block(x)`` gives all scores (n, classes) for wide data.
    """
    if features.dim <= WIDE_LIMIT:
        score_names = [f"__score_{i}" for i in range(len(classes))]
        elements = features.elements()
        scored = features.df.withColumns({n: expression(elements, i) for i, n in enumerate(score_names)})
        best = F.greatest(*score_names) if len(score_names) > 1 else F.col(score_names[0])
        choice: Column = F.lit(classes[-1])
        for name, c in reversed(list(zip(score_names[:-1], classes[:-1]))):
            choice = F.when(F.col(name) == best, F.lit(c)).otherwise(choice)
        return scored.select(*features.keys(), choice.cast("int").alias("y_pred"))
    table = np.array(classes, dtype=float)
    chosen = block_score(lambda x: table[block(x).argmax(axis=1)], features.array(), features.dim)
    return features.df.select(*features.keys(), chosen.cast("int").alias("y_pred"))


@dataclass(frozen=True)
class GaussianNB:
    classes: tuple[int, ...]
    priors: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def predict(self, features: Features) -> DataFrame:
        constant = np.log(self.priors) - 0.5 * np.log(2.0 * math.pi * self.variances).sum(axis=1)

        def expression(elements, i):
            total = F.lit(float(constant[i]))
            for e, m, v in zip(elements, self.means[i], self.variances[i]):
                total = total - (e - F.lit(float(m))) * (e - F.lit(float(m))) / F.lit(2.0 * float(v))
            return total

        means, variances = self.means, self.variances

        def block(x):
            return np.stack(
                [constant[i] - ((x - means[i]) ** 2 / (2 * variances[i])).sum(axis=1) for i in range(len(constant))],
                axis=1,
            )

        return predict_by_scores(features, self.classes, expression, block)


def fit_gaussian_nb(train: Features, seed: int = 0) -> GaussianNB:
    classes, counts, means, variances, overall = class_moments(train)
    floor = 1e-9 * overall.max()
    return GaussianNB(tuple(classes), counts / counts.sum(), means, variances + floor)


@dataclass(frozen=True)
class LinearNB:
    """Score = offset + x . weights, after clamping or binarising the features."""

    classes: tuple[int, ...]
    offsets: np.ndarray
    weights: np.ndarray
    binarise: bool

    def predict(self, features: Features) -> DataFrame:
        source = features if self.binarise else clamp_negatives(features)

        def expression(elements, i):
            total = F.lit(float(self.offsets[i]))
            for e, w in zip(elements, self.weights[i]):
                value = F.when(e > 0, 1.0).otherwise(0.0) if self.binarise else e
                total = total + value * F.lit(float(w))
            return total

        offsets, weights, binarise = self.offsets, self.weights, self.binarise

        def block(x):
            value = (x > 0).astype(float) if binarise else x
            return offsets + value @ weights.T

        return predict_by_scores(source, self.classes, expression, block)


def fit_multinomial_nb(train: Features, seed: int = 0, alpha: float = 1.0) -> LinearNB:
    """Smoothed feature shares per class and unsmoothed class shares."""
    classes, counts, sums = class_sums(clamp_negatives(train))
    smoothed = sums + alpha
    weights = np.log(smoothed) - np.log(smoothed.sum(axis=1, keepdims=True))
    return LinearNB(tuple(classes), np.log(counts / counts.sum()), weights, False)


def fit_bernoulli_nb(train: Features, seed: int = 0, alpha: float = 1.0) -> LinearNB:
    """Share of positive values per class and column."""
    classes, counts, positive = class_sums(
        train, lambda e: F.when(e > 0, 1.0).otherwise(0.0), lambda x: (x > 0).astype(float)
    )
    present = (positive + alpha) / (counts[:, None] + 2 * alpha)
    absent = np.log(1.0 - present)
    offsets = np.log(counts / counts.sum()) + absent.sum(axis=1)
    return LinearNB(tuple(classes), offsets, np.log(present) - absent, True)
