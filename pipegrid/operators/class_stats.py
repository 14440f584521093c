"""Per-class statistics of all feature columns, shared by several fits.

Up to ``WIDE_LIMIT`` columns they are one built-in aggregation with map-side combine;
wider data goes through numpy partial sums, one vector per partition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, WIDE_LIMIT, Features
from pipegrid.functions.blocks import partial_sums


def class_counts(train: Features) -> dict[int, int]:
    rows = train.df.groupBy("label").count().collect()
    return {int(r["label"]): r["count"] for r in sorted(rows, key=lambda r: r["label"])}


def class_sums(
    train: Features,
    expression: Callable[[Column], Column] = lambda e: e,
    block: Callable[[np.ndarray], np.ndarray] = lambda x: x,
) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Classes, row counts and sums of ``expression`` per class and column."""
    if train.dim <= WIDE_LIMIT:
        sums = [F.sum(expression(e)).alias(f"s_{j}") for j, e in enumerate(train.elements())]
        rows = train.df.groupBy("label").agg(F.count("*").alias("n"), *sums).collect()
        rows = sorted(rows, key=lambda r: r["label"])
        classes = [int(r["label"]) for r in rows]
        counts = np.array([r["n"] for r in rows], dtype=float)
        return classes, counts, np.array([[r[f"s_{j}"] for j in range(train.dim)] for r in rows], dtype=float)
    classes = list(class_counts(train))
    d = train.dim

    def partial(data):
        out = np.zeros((len(classes), d + 1))
        moved = block(data[ARRAY])
        for i, c in enumerate(classes):
            mine = data["label"] == c
            out[i, 0] = mine.sum()
            out[i, 1:] = moved[mine].sum(axis=0)
        return out.reshape(-1)

    total = partial_sums(train.with_array(), {ARRAY: d}, ["label"], partial, len(classes) * (d + 1))
    total = total.reshape(len(classes), d + 1)
    return classes, total[:, 0], total[:, 1:]


def class_moments(train: Features) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, counts, means, population variances per class, and overall variances."""
    if train.dim <= WIDE_LIMIT:
        elements = train.elements()
        aggregates = [F.avg(e).alias(f"m_{j}") for j, e in enumerate(elements)]
        aggregates += [F.var_pop(e).alias(f"v_{j}") for j, e in enumerate(elements)]
        rows = train.df.groupBy("label").agg(F.count("*").alias("n"), *aggregates).collect()
        rows = sorted(rows, key=lambda r: r["label"])
        classes = [int(r["label"]) for r in rows]
        counts = np.array([r["n"] for r in rows], dtype=float)
        means = np.array([[r[f"m_{j}"] for j in range(train.dim)] for r in rows], dtype=float)
        variances = np.array([[r[f"v_{j}"] for j in range(train.dim)] for r in rows], dtype=float)
    else:
        classes, counts, sums = class_sums(train)
        means = sums / counts[:, None]
        d = train.dim

        def partial(data):
            out = np.zeros((len(classes), d))
            for i, c in enumerate(classes):
                centred = data[ARRAY][data["label"] == c] - means[i]
                out[i] = (centred * centred).sum(axis=0)
            return out.reshape(-1)

        squares = partial_sums(train.with_array(), {ARRAY: d}, ["label"], partial, len(classes) * d)
        variances = squares.reshape(len(classes), d) / counts[:, None]
    share = counts / counts.sum()
    grand = share @ means
    overall = share @ variances + share @ (means - grand) ** 2
    return classes, counts, means, variances, overall


def class_scatter(train: Features) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Classes, counts, means and centred cross-products (d x d) per class."""
    classes, counts, sums = class_sums(train)
    means = sums / counts[:, None]
    d = train.dim

    def partial(data):
        out = np.zeros((len(classes), d, d))
        for i, c in enumerate(classes):
            centred = data[ARRAY][data["label"] == c] - means[i]
            out[i] = centred.T @ centred
        return out.reshape(-1)

    total = partial_sums(train.with_array(), {ARRAY: d}, ["label"], partial, len(classes) * d * d)
    return classes, counts, means, total.reshape(len(classes), d, d)


def gram(features: Features, center: np.ndarray | None = None) -> np.ndarray:
    """Sum of x xᵀ over all rows, optionally around ``center``."""
    d = features.dim
    shift = np.zeros(d) if center is None else center

    def partial(data):
        moved = data[ARRAY] - shift
        return (moved.T @ moved).reshape(-1)

    return partial_sums(features.with_array(), {ARRAY: d}, [], partial, d * d).reshape(d, d)


def column_means(features: Features) -> tuple[int, np.ndarray]:
    if features.dim <= WIDE_LIMIT:
        row = features.df.agg(F.count("*"), *[F.avg(e) for e in features.elements()]).first()
        return int(row[0]), np.array(row[1:], dtype=float)
    d = features.dim

    def partial(data):
        return np.append(data[ARRAY].sum(axis=0), len(data[ARRAY]))

    total = partial_sums(features.with_array(), {ARRAY: d}, [], partial, d + 1)
    return int(total[-1]), total[:-1] / total[-1]
