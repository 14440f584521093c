"""Synthetic predict-then-optimise data on a grid, as a function of row keys."""

from __future__ import annotations

import math
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipegrid.functions.blocks import as_block
from pipegrid.functions.hashing import TWO32, hash_normal, hash_uniform, local_uniform
from pipegrid.functions.joins import join_keyed

N_FEATURES = 5
GRID = (5, 5)


def grid_edges(grid: tuple[int, int] = GRID) -> list[tuple[int, int]]:
    """Edges (from, to) in order: per grid row first the moves right, then the moves down."""
    rows, cols = grid
    edges = []
    for i in range(rows):
        edges += [(i * cols + j, i * cols + j + 1) for j in range(cols - 1)]
        if i + 1 < rows:
            edges += [(i * cols + j, (i + 1) * cols + j) for j in range(cols)]
    return edges


def cost_pattern(seed: int, n_edges: int, n_features: int = N_FEATURES) -> list[list[float]]:
    """The 0/1 matrix that says which features drive which edge."""
    return [
        [float(local_uniform(f"B:{seed}:", f"{e}:{j}") < 0.5) for j in range(n_features)] for e in range(n_edges)
    ]


def cost_patterns(seed: Column, n_edges: int, n_features: int = N_FEATURES) -> Column:
    """:func:`cost_pattern` as a column, so that seeds never come to the driver."""
    salt = F.concat(seed.cast("string"), F.lit(":"))

    def row(e):
        return F.array(
            *[
                (hash_uniform("B:", F.concat(e.cast("string"), F.lit(f":{j}")), salt) < 0.5).cast("double")
                for j in range(n_features)
            ]
        )

    return F.transform(F.sequence(F.lit(0), F.lit(n_edges - 1)), row)


def generate_costs(
    instances: DataFrame, n_features: int = N_FEATURES, grid: tuple[int, int] = GRID, native: bool = False
) -> DataFrame:
    """Add ``features`` and ``costs`` to rows of (instance_id, degree, noise, seed, ...).

    cost = ((B x / sqrt(p) + 3)^degree + 1) / 3.5^degree * U(1 - noise, 1 + noise)
    Everything is a function of the row, so there is no join and no shuffle: the 0/1 pattern
    of a seed follows from the seed, and a worker keeps the patterns it met last. Rows
    without a seed are left out; without key, degree or noise their costs are NULL.
    ``native`` does without Python: the patterns then come from a table with a row per seed.
    """
    n_edges = len(grid_edges(grid))
    key, salt = F.col("instance_id"), F.col("seed").cast("string")
    features = F.array(
        *[hash_normal(f"x{j}:", F.concat(F.lit(":"), key.cast("string")), salt) for j in range(n_features)]
    )
    drawn = instances.filter(F.col("seed").isNotNull()).withColumn("features", features)
    drawn = drawn.select("seed", *[c for c in drawn.columns if c != "seed"])
    if native:
        return _native_costs(drawn, n_edges, n_features)

    @F.arrow_udf("array<double>")
    def costs(salts: pa.Array, keys: pa.Array, degree: pa.Array, noise: pa.Array, x: pa.Array) -> pa.Array:
        known = pc.and_(pc.and_(keys.is_valid(), degree.is_valid()), noise.is_valid()).to_numpy(zero_copy_only=False)
        out = np.full((len(keys), n_edges), np.nan)
        rows = np.flatnonzero(known)
        if len(rows):
            at = pa.array(rows)
            salts, keys = salts.take(at).dictionary_encode(), keys.take(at).to_pylist()
            blocks = (pc.cast(v.take(at), pa.float64()).to_numpy(zero_copy_only=False) for v in (degree, noise))
            out[rows] = _costs(salts.dictionary.to_pylist(), salts.indices.to_numpy(), keys, *blocks, as_block(x.take(at), n_features), n_edges)
        offsets = np.arange(0, out.size + 1, n_edges, dtype=np.int32)
        missing = None if known.all() else np.repeat(~known, n_edges)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.reshape(-1), mask=missing))

    return drawn.withColumn("costs", costs(salt, key.cast("string"), F.col("degree"), F.col("noise"), F.col("features")))


def _native_costs(drawn: DataFrame, n_edges: int, n_features: int) -> DataFrame:
    patterns = drawn.select("seed").distinct().withColumn("pattern", cost_patterns(F.col("seed"), n_edges, n_features))
    degree, width = F.col("degree"), F.col("noise")
    end = F.concat(F.lit(":"), F.col("seed").cast("string"), F.lit(":"), F.col("instance_id").cast("string"))

    def cost(row, e):
        # one lambda over the edges keeps the plan small; unrolled it would not compile
        dot = row[0] * F.col("features")[0]
        for j in range(1, n_features):
            dot = dot + row[j] * F.col("features")[j]
        base = (F.pow(dot / math.sqrt(n_features) + 3.0, degree) + 1.0) / F.pow(F.lit(3.5), degree)
        return base * F.when(width == 0, 1.0).otherwise(1.0 - width + 2.0 * width * hash_uniform("noise", F.concat(e.cast("string"), end)))

    edges = F.sequence(F.lit(0), F.lit(n_edges - 1))
    joined = join_keyed(drawn, patterns, "seed", F.col("instance_id"))
    return joined.withColumn("costs", F.zip_with("pattern", edges, cost)).drop("pattern")


@lru_cache(maxsize=1 << 16)  # some 20 MB
def _pattern(seed: str, n_edges: int, n_features: int) -> np.ndarray:
    return np.array(cost_pattern(seed, n_edges, n_features), dtype=np.uint8)


def _costs(seeds: list[str], at: np.ndarray, keys: list[str], degree: np.ndarray, noise: np.ndarray, x: np.ndarray, n_edges: int) -> np.ndarray:
    """(rows, edges): the costs of rows, of which each has the seed ``seeds[at]``."""
    pattern = np.stack([_pattern(seed, n_edges, x.shape[1]) for seed in seeds])
    dot = x[:, :1] * pattern[at, :, 0]
    for j in range(1, x.shape[1]):
        dot += x[:, j : j + 1] * pattern[at, :, j]
    degree = degree[:, None]
    base = (np.power(dot / math.sqrt(x.shape[1]) + 3.0, degree) + 1.0) / np.power(3.5, degree)
    noisy = np.flatnonzero(noise != 0)
    if len(noisy):
        ends = [f":{seeds[at[i]]}:{keys[i]}".encode() for i in noisy]
        drawn = np.empty((n_edges, len(noisy)))
        for e in range(n_edges):
            head = f"noise{e}".encode()
            drawn[e] = np.frombuffer(b"".join([md5(head + end).digest()[:4] for end in ends]), ">u4")
        width = noise[noisy][:, None]
        base[noisy] *= 1.0 - width + 2.0 * width * (drawn.T / TWO32)
    return base


def sweep_instances(configs: DataFrame, test_rows: int = 1000) -> DataFrame:
    """Training and test rows for every configuration in one table.

    Rows are independent draws keyed by their number, so the last ``test_rows`` numbers
    are as random a holdout as a shuffled one.
    """
    size = F.col("training_size")
    rows = configs.select("*", F.explode(F.sequence(F.lit(0), size + test_rows - 1)).alias("instance_id"))
    rows = rows.withColumn("split", F.when(F.col("instance_id") < size, "train").otherwise("test"))
    return generate_costs(rows.withColumn("instance_id", F.col("instance_id").cast("bigint")))
