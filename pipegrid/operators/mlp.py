"""A one-hidden-layer network by local Adam steps and parameter averaging.

Rows are hashed into shards whose number depends on the data only. Per epoch each shard
takes mini-batch steps from the shared parameters; their averages start the next epoch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, Features
from pipegrid.functions.blocks import block_score, partition_fold
from pipegrid.functions.hashing import hash_uniform
from pipegrid.operators.linear import shards
from pipegrid.session import held

HIDDEN = 32


def adam_step(parameters, gradient, first, second, count, rate, betas=(0.9, 0.999), epsilon=1e-8):
    first = betas[0] * first + (1 - betas[0]) * gradient
    second = betas[1] * second + (1 - betas[1]) * gradient * gradient
    scale = rate * np.sqrt(1 - betas[1] ** count) / (1 - betas[0] ** count)
    return parameters - scale * first / (np.sqrt(second) + epsilon), first, second


def _unpack(parameters: np.ndarray, d: int):
    h = HIDDEN
    w1 = parameters[: d * h].reshape(d, h)
    b1 = parameters[d * h : d * h + h]
    w2 = parameters[d * h + h : d * h + 2 * h]
    return w1, b1, w2, parameters[-1]


def forward(parameters: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log-odds of class 1."""
    w1, b1, w2, b2 = _unpack(parameters, x.shape[1])
    return np.maximum(x @ w1 + b1, 0.0) @ w2 + b2


def _gradient(parameters: np.ndarray, x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    w1, b1, w2, b2 = _unpack(parameters, x.shape[1])
    hidden = np.maximum(x @ w1 + b1, 0.0)
    odds = np.clip(hidden @ w2 + b2, -500, 500)
    error = (1.0 / (1.0 + np.exp(-odds)) - y) / len(x)
    back = np.outer(error, w2) * (hidden > 0)
    decay = alpha / len(x)
    return np.concatenate(
        [(x.T @ back + decay * w1).reshape(-1), back.sum(axis=0), hidden.T @ error + decay * w2, [error.sum()]]
    )


@dataclass(frozen=True)
class Network:
    parameters: np.ndarray

    def predict(self, features: Features) -> DataFrame:
        parameters = self.parameters
        odds = block_score(lambda x: forward(parameters, x), features.array(), features.dim)
        return features.df.select(*features.keys(), F.when(odds > 0, 1).otherwise(0).alias("y_pred"))


def fit_mlp(
    train: Features,
    seed: int = 0,
    epochs: int = 512,
    patience: int = 32,
    batch: int = 200,
    rate: float = 1e-3,
    alpha: float = 1e-4,
    tolerance: float = 1e-4,
    held_out: float = 0.1,
) -> Network:
    """Stops when the accuracy on a hashed tenth of the rows has not improved for ``patience`` epochs."""
    d, h = train.dim, HIDDEN
    draw = np.random.default_rng([seed, d])
    bound1, bound2 = np.sqrt(6.0 / (d + h)), np.sqrt(2.0 / (h + 1))
    size = d * h + 2 * h + 1
    parameters = np.concatenate(
        [
            draw.uniform(-bound1, bound1, d * h),
            draw.uniform(-bound1, bound1, h),
            draw.uniform(-bound2, bound2, h),
            draw.uniform(-bound2, bound2, 1),
        ]
    )
    first, second, count = np.zeros(size), np.zeros(size), 0.0
    is_valid = (hash_uniform(f"mlp:{seed}:", F.col("row_id")) < held_out).cast("int").alias("valid")
    best, best_score, stale = parameters, -np.inf, 0
    with held(shards(train.with_array().select("*", is_valid), seed)) as rows:
        for _ in range(epochs):

            def start(p=parameters, m=first, v=second, c=count):
                # parameters, moments, steps taken, rows trained on, valid hits, valid rows
                return [p, m, v, c, 0.0, 0.0, 0.0, p]

            def step(state, data):
                p, m, v, c, n, hits, n_valid, shared = state
                x, y, valid = data[ARRAY], data["label"].astype(float), data["valid"] > 0
                if valid.any():
                    hits += ((forward(shared, x[valid]) > 0) == (y[valid] > 0)).sum()
                    n_valid += valid.sum()
                x, y = x[~valid], y[~valid]
                for i in range(0, len(x), batch):
                    c += 1
                    p, m, v = adam_step(p, _gradient(p, x[i : i + batch], y[i : i + batch], alpha), m, v, c, rate)
                return [p, m, v, c, n + len(x), hits, n_valid, shared]

            def finish(state):
                p, m, v, c, n, hits, n_valid, _ = state
                return np.concatenate([n * p, n * m, n * v, [n * c, n, hits, n_valid]])

            total = partition_fold(rows, {ARRAY: d}, ["label", "valid"], start, step, finish, 3 * size + 4)
            n, hits, n_valid = total[-3], total[-2], total[-1]
            score = hits / n_valid if n_valid else 0.0
            if score > best_score + tolerance:
                stale = 0
            else:
                stale += 1
            if score > best_score:
                best, best_score = parameters, score
            if stale > patience or n == 0:
                break
            parameters = total[:size] / n
            first, second = total[size : 2 * size] / n, total[2 * size : 3 * size] / n
            count = total[-4] / n
    return Network(best)
