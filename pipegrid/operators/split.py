"""Holdout and predefined splits whose size and rows do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.functions.hashing import hash_bits

READ_OFF = 20_000


def holdout_fraction(
    df: DataFrame, fraction: float, seed: int, key: str = "row_id", out: str = "split", keys: DataFrame | None = None
) -> DataFrame:
    """Exactly ceil(fraction * n) rows become test, chosen by smallest hash.

    ``keys`` may name a cheaper table with the same keys, to find the cut without
    computing ``df``.
    """
    source = df if keys is None else keys
    n = source.count()
    return _holdout(df, source, math.ceil(fraction * n), n, seed, key, out)


def holdout_size(
    df: DataFrame, size: int, seed: int, key: str = "row_id", out: str = "split", keys: DataFrame | None = None
) -> DataFrame:
    """Exactly ``size`` rows become test (all rows if there are fewer)."""
    source = df if keys is None else keys
    n = source.count()
    return _holdout(df, source, min(size, n), n, seed, key, out)


def _holdout(df: DataFrame, source: DataFrame, size: int, n: int, seed: int, key: str, out: str) -> DataFrame:
    # a narrow expression: no join, no sort, no shuffle of the rows themselves
    return df.withColumn(out, F.when(_is_test(source, size, n, seed, key), "test").otherwise("train"))


def _is_test(df: DataFrame, size: int, n: int, seed: int, key: str):
    bits = hash_bits(f"split:{seed}:", F.col(key))
    if size <= 0 or size >= n:
        return F.lit(size > 0)
    cut_bits, cut_key = _kth_smallest(df.select(bits.alias("u"), F.col(key).alias("k")), size)
    return (bits < cut_bits) | ((bits == cut_bits) & (F.col(key) <= cut_key))


def _kth_smallest(hashed: DataFrame, k: int, read_off: int = READ_OFF) -> tuple[int, int]:
    """The k-th smallest (u, key): narrow by 16 bits at a time, then sort one small slot."""
    remaining, below, shift = hashed, k, 32
    while True:
        shift -= 16
        slots = (
            remaining.groupBy(F.shiftright("u", shift).alias("slot"))
            .count()
            .orderBy("slot")
            .collect()
        )
        for row in slots:
            if below <= row["count"]:
                break
            below -= row["count"]
        remaining = remaining.filter(F.shiftright("u", shift) == row["slot"])
        if row["count"] <= read_off or shift == 0:
            break
    cut = remaining.orderBy("u", "k").limit(below).agg(F.max(F.struct("u", "k")).alias("cut")).first()["cut"]
    return cut["u"], cut["k"]


def predefined_split(df: DataFrame, folds: DataFrame, fold: int = 0, key: str = "row_id") -> DataFrame:
    """Rows listed in ``folds(row_id, fold, split)`` for one fold, with their side."""
    side = folds.filter(F.col("fold") == fold).select(key, "split")
    return df.join(side, key)


def two_phases(
    df: DataFrame, seed: int, key: str = "row_id", fraction: float = 0.33, keys: DataFrame | None = None
) -> DataFrame:
    """Add ``test_split`` (train/test) and, inside its train rows, ``split`` (train/test; else NULL).

    ``keys`` as in :func:`holdout_fraction`.
    """
    outer = holdout_fraction(df, fraction, seed, key, "test_split", keys)
    told = outer if keys is None else holdout_fraction(keys, fraction, seed, key, "test_split")
    inside = told.filter(F.col("test_split") == "train")
    n = inside.count()
    is_valid = _is_test(inside, math.ceil(fraction * n), n, seed + 1, key)
    side = F.when(is_valid, "test").otherwise("train")
    return outer.withColumn("split", F.when(F.col("test_split") == "train", side))
