"""Feature expansion: degree-2 polynomial and random Fourier features."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, WIDE_LIMIT, Features, from_array
from pipegrid.functions.blocks import block_map
from pipegrid.functions.hashing import local_normal, local_uniform


@dataclass(frozen=True)
class Polynomial2:
    """1, all columns, then all products x_i * x_j with i <= j, as one array column."""

    def apply(self, features: Features) -> Features:
        d = features.dim
        width = (d + 1) * (d + 2) // 2
        if width <= WIDE_LIMIT:
            e = features.elements()
            terms = [F.lit(1.0), *e, *[e[i] * e[j] for i in range(d) for j in range(i, d)]]
            made = F.array(*terms)
        else:
            left, right = np.triu_indices(d)

            def expand(x: np.ndarray) -> np.ndarray:
                return np.hstack([np.ones((len(x), 1)), x, x[:, left] * x[:, right]])

            made = block_map(expand, features.array(), d)
        return from_array(features.df.select(*features.keys(), made.alias(ARRAY)), width)


def fit_polynomial(train: Features, seed: int = 0) -> Polynomial2:
    return Polynomial2()


@dataclass(frozen=True)
class FourierMap:
    """sqrt(2/m) * cos(xW + b): a random map whose inner product approximates the RBF kernel."""

    weights: np.ndarray
    offsets: np.ndarray

    def apply(self, features: Features) -> Features:
        weights, offsets = self.weights, self.offsets
        m = len(offsets)
        made = block_map(
            lambda x: math.sqrt(2.0 / m) * np.cos(x @ weights + offsets), features.array(), features.dim
        )
        return from_array(features.df.select(*features.keys(), made.alias(ARRAY)), m)


def fit_fourier(train: Features, seed: int = 0, gamma: float = 1.0, components: int = 100) -> FourierMap:
    """Weights N(0, 2*gamma) and offsets U(0, 2*pi), each a hash of (seed, position)."""
    scale = math.sqrt(2.0 * gamma)
    weights = np.array(
        [
            [scale * local_normal(f"rbf_w:{seed}:", f"{j}:{k}") for k in range(components)]
            for j in range(train.dim)
        ]
    )
    offsets = np.array([2.0 * math.pi * local_uniform(f"rbf_b:{seed}:", k) for k in range(components)])
    return FourierMap(weights, offsets)
