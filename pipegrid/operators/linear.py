"""Linear classifiers as convex problems: every iteration is one pass of summed numpy statistics."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, WIDE_LIMIT, Features
from pipegrid.functions.blocks import block_score, partial_sums, partition_fold
from pipegrid.functions.hashing import hash_bits
from pipegrid.session import held

STEPS = 0.5 ** np.arange(12)


@dataclass(frozen=True)
class LinearModel:
    """Class 1 when x . w + b > 0."""

    weights: np.ndarray  # d coefficients, then the intercept

    def predict(self, features: Features) -> DataFrame:
        if features.dim <= WIDE_LIMIT:
            score = F.lit(float(self.weights[-1]))
            for e, w in zip(features.elements(), self.weights):
                score = score + e * F.lit(float(w))
        else:
            weights = self.weights
            score = block_score(lambda x: x @ weights[:-1] + weights[-1], features.array(), features.dim)
        return features.df.select(*features.keys(), F.when(score > 0, 1).otherwise(0).alias("y_pred"))


def _augmented(data: dict) -> tuple[np.ndarray, np.ndarray]:
    x = np.hstack([data[ARRAY], np.ones((len(data[ARRAY]), 1))])
    return x, np.where(data["label"] > 0, 1.0, -1.0)


def _hinge_statistics(rows: DataFrame, d: int, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of squared hinge losses, its gradient and its generalised Hessian at w."""
    p = d + 1

    def partial(data):
        x, y = _augmented(data)
        slack = 1.0 - y * (x @ w)
        active = slack > 0
        xa, ya, sa = x[active], y[active], slack[active]
        return np.concatenate([[(sa * sa).sum()], -2.0 * xa.T @ (ya * sa), (2.0 * xa.T @ xa).reshape(-1)])

    total = partial_sums(rows, {ARRAY: d}, ["label"], partial, 1 + p + p * p)
    return total[0], total[1 : 1 + p], total[1 + p :].reshape(p, p)


def _losses_along(rows: DataFrame, d: int, w: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Squared hinge loss at all trial steps in one pass."""

    def partial(data):
        x, y = _augmented(data)
        slack = 1.0 - y[:, None] * ((x @ w)[:, None] + (x @ direction)[:, None] * STEPS[None, :])
        return (np.maximum(slack, 0.0) ** 2).sum(axis=0)

    return partial_sums(rows, {ARRAY: d}, ["label"], partial, len(STEPS))


def fit_squared_hinge(train: Features, seed: int = 0, c: float = 1.0, iterations: int = 30, tolerance: float = 1e-6) -> LinearModel:
    """min 1/2 |w|^2 + C sum max(0, 1 - y f)^2 by Newton steps; the intercept is penalised too."""
    d = train.dim
    w = np.zeros(d + 1)
    with held(train.with_array()) as rows:
        first = None
        for _ in range(iterations):
            loss, gradient, hessian = _hinge_statistics(rows, d, w)
            gradient = w + c * gradient
            size = np.linalg.norm(gradient)
            first = size if first is None else first
            if size <= tolerance * max(first, 1.0):
                break
            direction = -np.linalg.solve(np.eye(d + 1) + c * hessian, gradient)
            trial = w[None, :] + STEPS[:, None] * direction[None, :]
            objective = 0.5 * (trial * trial).sum(axis=1) + c * _losses_along(rows, d, w, direction)
            best = int(objective.argmin())
            if objective[best] >= 0.5 * w @ w + c * loss:
                break
            w = trial[best]
        else:
            warnings.warn(f"squared hinge: not converged after {iterations} passes", stacklevel=2)
    return LinearModel(w)


def squared_hinge_gradient(train: Features, w: np.ndarray, c: float = 1.0) -> np.ndarray:
    _, gradient, _ = _hinge_statistics(train.with_array(), train.dim, w)
    return w + c * gradient


def fit_l1_squared_hinge(train: Features, c: float = 1.0, iterations: int = 40, tolerance: float = 1e-5) -> np.ndarray:
    """min |w|_1 + C sum max(0, 1 - y f)^2: coordinate descent on the second-order model per pass."""
    d = train.dim
    w = np.zeros(d + 1)
    with held(train.with_array()) as rows:
        for _ in range(iterations):
            loss, gradient, hessian = _hinge_statistics(rows, d, w)
            gradient, hessian = c * gradient, c * hessian + 1e-12 * np.eye(d + 1)
            target = w.copy()
            pull = np.zeros(d + 1)  # hessian @ (target - w)
            for _ in range(200):
                moved = 0.0
                for j in range(d + 1):
                    slope = gradient[j] + pull[j]
                    middle = target[j] - slope / hessian[j, j]
                    fresh = np.sign(middle) * max(abs(middle) - 1.0 / hessian[j, j], 0.0)
                    if fresh != target[j]:
                        pull += hessian[:, j] * (fresh - target[j])
                        moved = max(moved, abs(fresh - target[j]))
                        target[j] = fresh
                if moved < 1e-8:
                    break
            direction = target - w
            if np.abs(direction).max() <= tolerance * max(1.0, np.abs(w).max()):
                break
            trial = w[None, :] + STEPS[:, None] * direction[None, :]
            objective = np.abs(trial).sum(axis=1) + c * _losses_along(rows, d, w, direction)
            best = int(objective.argmin())
            if objective[best] >= np.abs(w).sum() + c * loss:
                break
            w = trial[best]
        else:
            warnings.warn(f"L1 squared hinge: not converged after {iterations} passes", stacklevel=2)
    return w


def fit_logistic(train: Features, seed: int = 0, alpha: float = 1e-4) -> LinearModel:
    """The logistic loss with an L2 penalty, solved to its optimum."""
    learner = LogisticRegression(
        featuresCol=ARRAY, labelCol="label", regParam=alpha, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8
    )
    model = learner.fit(train.with_vector())
    return LinearModel(np.append(model.coefficients.toArray(), model.intercept))


ROWS_PER_SHARD = 1_000_000
MIN_SHARDS = 8


def shards(rows: DataFrame, seed: int) -> DataFrame:
    """Rows hashed into a number of shards that depends on the data only, in hash order."""
    n = rows.count()
    order = hash_bits(f"shard:{seed}:", F.col("row_id"))
    count = max(MIN_SHARDS, -(-n // ROWS_PER_SHARD))
    # one partition per shard, whose borders are fixed numbers of the hash
    shard = F.floor(order * F.lit(count) / F.lit(4294967296)).cast("int")
    spread = rows.withColumn("__shard", shard).withColumn("__order", order)
    return spread.repartitionById(count, F.col("__shard")).sortWithinPartitions("__shard", "__order", "row_id")


def fit_passive_aggressive(
    train: Features, seed: int = 0, c: float = 1.0, epochs: int = 30, batch: int = 16, tolerance: float = 1e-4
) -> LinearModel:
    """Passive-aggressive updates inside hash shards, parameters averaged after each epoch."""
    d = train.dim
    w = np.zeros(d + 1)
    best, best_loss, stale = w, np.inf, 0
    with held(shards(train.with_array(), seed)) as rows:
        for _ in range(epochs):

            def start(w=w):
                return w.copy(), 0.0, 0.0

            def step(state, data):
                w, n, loss = state
                x, y = _augmented(data)
                norms = (x * x).sum(axis=1)
                for i in range(0, len(x), batch):
                    part, side, norm = x[i : i + batch], y[i : i + batch], norms[i : i + batch]
                    lost = np.maximum(0.0, 1.0 - side * (part @ w))
                    rate = np.minimum(c, lost / norm) * side
                    w = w + rate @ part / len(part)
                    loss += lost.sum()
                return w, n + len(x), loss

            def finish(state):
                w, n, loss = state
                return np.concatenate([w * n, [n, loss]])

            total = partition_fold(rows, {ARRAY: d}, ["label"], start, step, finish, d + 3)
            w = total[: d + 1] / total[d + 1]
            mean_loss = total[d + 2] / total[d + 1]
            if mean_loss < best_loss - tolerance:
                best, best_loss, stale = w, mean_loss, 0
            else:
                stale += 1
                if stale >= 5:
                    break
        else:
            warnings.warn(f"passive-aggressive: not settled after {epochs} epochs", stacklevel=2)
    return LinearModel(w if best_loss == np.inf else best)
