"""Scalers: statistics in one pass over the training rows, applied as expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, Features, from_array, spread
from pipegrid.functions.blocks import block_map, partial_sums
from pipegrid.functions.quantiles import column_quantiles


@dataclass(frozen=True)
class Affine:
    """(x - center) / scale per column."""

    center: tuple[float, ...]
    scale: tuple[float, ...]

    def apply(self, features: Features) -> Features:
        if features.is_wide:
            center, scale = np.array(self.center), np.array(self.scale)
            moved = block_map(lambda x: (x - center) / scale, features.array(), features.dim)
            return from_array(features.df.select(*features.keys(), moved.alias(ARRAY)), features.dim)
        moved = [
            (e - F.lit(c)) / F.lit(s) for e, c, s in zip(features.elements(), self.center, self.scale)
        ]
        return features.replace_elements(moved)


def _statistics(train: Features, *functions) -> list[list[float]]:
    elements = train.elements()
    wanted = [f(e).alias(f"s{i}_{j}") for i, f in enumerate(functions) for j, e in enumerate(elements)]
    row = train.df.agg(*wanted).first()
    d = len(elements)
    return [list(row[i * d : (i + 1) * d]) for i in range(len(functions))]


def fit_standard(train: Features, seed: int = 0) -> Affine:
    """Centre by mean, divide by the population deviation; a constant column becomes 0."""
    means, deviations = _statistics(train, F.avg, F.stddev_pop)
    # rounding leaves a tiny deviation on constant columns
    scales = [s if s > 10 * np.finfo(float).eps * abs(m) else 1.0 for m, s in zip(means, deviations)]
    return Affine(tuple(means), tuple(scales))


def fit_min_max(train: Features, seed: int = 0) -> Affine:
    """Map [min, max] to [0, 1] without clipping; a constant column becomes 0."""
    low, high = _statistics(train, F.min, F.max)
    return Affine(tuple(low), tuple((b - a) or 1.0 for a, b in zip(low, high)))


def fit_robust(train: Features, seed: int = 0, lower: float = 0.25, upper: float = 0.75) -> Affine:
    """Centre by median, divide by a quantile range given in percent.

    The default range really is the 0.25th to the 0.75th percentile.
    """
    quantiles = column_quantiles(train.df, train.elements(), [lower / 100.0, 0.5, upper / 100.0])
    return Affine(tuple(q[1] for q in quantiles), tuple((q[2] - q[0]) or 1.0 for q in quantiles))


def fit_robust_quartiles(train: Features, seed: int = 0) -> Affine:
    return fit_robust(train, seed, 25.0, 75.0)


@dataclass(frozen=True)
class RowNormalizer:
    """Divide each row by its Euclidean length; a zero row stays zero."""

    def apply(self, features: Features) -> Features:
        if features.is_wide:

            def unit(x):
                length = np.sqrt((x * x).sum(axis=1, keepdims=True))
                return x / np.where(length == 0, 1.0, length)

            moved = block_map(unit, features.array(), features.dim)
            return from_array(features.df.select(*features.keys(), moved.alias(ARRAY)), features.dim)
        squares = features.elements()[0] * features.elements()[0]
        for e in features.elements()[1:]:
            squares = squares + e * e
        # the length is its own projection, so it is computed once per row
        with_length = features.df.withColumn("__len", F.sqrt(squares))
        divisor = F.when(F.col("__len") == 0, F.lit(1.0)).otherwise(F.col("__len"))
        moved = [(e / divisor).alias(n) for e, n in zip(features.elements(), features.names)]
        return Features(with_length.select(*features.keys(), *moved), features.names)


def fit_normalizer(train: Features, seed: int = 0) -> RowNormalizer:
    return RowNormalizer()


@dataclass(frozen=True)
class QuantileMap:
    """Empirical distribution function with linear interpolation between quantiles."""

    knots: tuple[tuple[float, ...], ...]  # distinct quantile values per column
    first: tuple[tuple[float, ...], ...]  # lowest and highest probability at each knot
    last: tuple[tuple[float, ...], ...]

    def apply(self, features: Features) -> Features:
        tables = [(np.array(k), np.array(a), np.array(b)) for k, a, b in zip(self.knots, self.first, self.last)]

        def mapped(block: np.ndarray) -> np.ndarray:
            out = np.empty_like(block)
            for j, (knots, first, last) in enumerate(tables):
                x = block[:, j]
                at = np.clip(np.searchsorted(knots, x, side="right") - 1, 0, len(knots) - 1)
                after = np.minimum(at + 1, len(knots) - 1)
                gap = knots[after] - knots[at]
                share = np.divide(x - knots[at], gap, out=np.zeros_like(x), where=gap > 0)
                value = last[at] + share * (first[after] - last[at])
                value = np.where(x == knots[at], (first[at] + last[at]) / 2.0, value)
                value = np.where(x >= knots[-1], 1.0, value)
                out[:, j] = np.where(x <= knots[0], 0.0, value)
            return out

        moved = block_map(mapped, features.array(), features.dim)
        return from_array(features.df.select(*features.keys(), moved.alias(ARRAY)), features.dim)


def fit_quantile_map(train: Features, seed: int = 0, n_quantiles: int = 1000) -> QuantileMap:
    q = min(n_quantiles, train.df.count())
    probabilities = np.arange(q) / max(q - 1, 1)
    knots, first, last = [], [], []
    for values in column_quantiles(train.df, train.elements(), list(probabilities)):
        # interpolation noise must not break the order
        values = np.maximum.accumulate(np.array(values))
        distinct, low = np.unique(values, return_index=True)
        high = np.append(low[1:], len(values)) - 1
        knots.append(tuple(distinct.tolist()))
        first.append(tuple(probabilities[low].tolist()))
        last.append(tuple(probabilities[high].tolist()))
    return QuantileMap(tuple(knots), tuple(first), tuple(last))


def yeo_johnson(x: Column, lam: float) -> Column:
    """The Yeo-Johnson power transform of one column for a fixed exponent."""
    if abs(lam) < 1e-12:
        positive = F.log1p(x)
    else:
        positive = (F.pow(x + 1.0, F.lit(lam)) - 1.0) / lam
    if abs(lam - 2.0) < 1e-12:
        negative = -F.log1p(-x)
    else:
        negative = -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / (2.0 - lam)
    return F.when(x >= 0, positive).otherwise(negative)


def _yeo_johnson_block(x: np.ndarray, lam: np.ndarray) -> np.ndarray:
    up, down = np.maximum(x, 0.0), np.minimum(x, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        positive = np.where(np.abs(lam) < 1e-12, np.log1p(up), np.expm1(lam * np.log1p(up)) / lam)
        back = 2.0 - lam
        negative = np.where(np.abs(back) < 1e-12, -np.log1p(-down), -np.expm1(back * np.log1p(-down)) / back)
    return np.where(x >= 0, positive, negative)


@dataclass(frozen=True)
class PowerMap:
    lambdas: tuple[float, ...]
    standard: Affine

    def apply(self, features: Features) -> Features:
        flat = spread(features)
        moved = [yeo_johnson(e, lam) for e, lam in zip(flat.elements(), self.lambdas)]
        return self.standard.apply(flat.replace_elements(moved))


def yeo_johnson_likelihoods(train: Features, candidates: np.ndarray) -> np.ndarray:
    """Log-likelihood per column and candidate exponent, all in one pass.

    ``candidates`` is (columns, k). Returns (columns, k). The variance uses sums around
    the transform of the column mean, which avoids cancellation.
    """
    d, k = candidates.shape
    origin_row = train.df.agg(*[F.avg(e) for e in train.elements()]).first()
    origin = np.array([float(v) for v in origin_row])
    pivots = np.stack([_yeo_johnson_block(origin, candidates[:, i]) for i in range(k)], axis=1)

    def partial(data):
        x = data[ARRAY]
        out = np.empty((d, 2 * k + 2))
        for i in range(k):
            moved = _yeo_johnson_block(x, candidates[:, i]) - pivots[:, i]
            out[:, i] = moved.sum(axis=0)
            out[:, k + i] = (moved * moved).sum(axis=0)
        out[:, 2 * k] = (np.sign(x) * np.log1p(np.abs(x))).sum(axis=0)
        out[:, 2 * k + 1] = len(x)
        return out.reshape(-1)

    total = partial_sums(train.with_array(), {ARRAY: d}, [], partial, d * (2 * k + 2)).reshape(d, -1)
    n = total[:, -1:]
    mean = total[:, :k] / n
    variance = np.maximum(total[:, k : 2 * k] / n - mean * mean, 1e-300)
    return -n / 2.0 * np.log(variance) + (candidates - 1.0) * total[:, 2 * k : 2 * k + 1]


def _argmax_of(train: Features, lambdas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and value of each column's best candidate; one that overflows is never best."""
    score = yeo_johnson_likelihoods(train, lambdas)
    score = np.where(np.isfinite(score), score, -np.inf)
    return score.argmax(axis=1), score.max(axis=1)


def fit_power(
    train: Features,
    seed: int = 0,
    low: float = -4.0,
    high: float = 4.0,
    candidates: int = 17,
    passes: int = 6,
    widen: bool = True,
) -> PowerMap:
    """Exponent of maximum likelihood by repeated grids, all columns per pass; then standardise.

    Where the best exponent is the first or last of the first grid, the grid moves on by twice its width, until it
    holds a maximum or the likelihood no longer changes; without ``widen`` the exponent is one of the given range.
    """
    lambdas = np.tile(np.linspace(low, high, candidates), (train.dim, 1))
    at, known = _argmax_of(train, lambdas) if widen else (np.full(train.dim, 1), None)
    while ((at == 0) | (at == candidates - 1)).any():
        side = np.where(at == 0, -1.0, np.where(at == candidates - 1, 1.0, 0.0))
        width = (lambdas[:, -1] - lambdas[:, 0]) * np.where(side != 0, 2.0, 1.0)
        start = np.where(side < 0, lambdas[:, 1] - width, np.where(side > 0, lambdas[:, -2], lambdas[:, 0]))
        wider = start[:, None] + width[:, None] * np.linspace(0.0, 1.0, candidates)[None, :]
        at_wider, moved = _argmax_of(train, wider)
        gained = (side != 0) & (moved > known + 1e-9 * np.abs(known))
        if not gained.any():
            break
        lambdas = np.where(gained[:, None], wider, lambdas)
        at, known = np.where(gained, at_wider, candidates // 2), np.where(gained, moved, known)
    best = lambdas[:, 0]
    for _ in range(passes):
        best = lambdas[np.arange(train.dim), _argmax_of(train, lambdas)[0]]
        step = lambdas[:, 1] - lambdas[:, 0]
        offsets = np.linspace(-1.0, 1.0, candidates)
        lambdas = best[:, None] + step[:, None] * offsets[None, :]
    flat = spread(train)
    moved = flat.replace_elements([yeo_johnson(e, float(b)) for e, b in zip(flat.elements(), best)])
    return PowerMap(tuple(best.tolist()), fit_standard(moved))
