"""Joins of many rows with a table of one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT = 10_000
FEW = 1_000


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str, salt: Column, rows_per_salt: int = ROWS_PER_SALT, few: int = FEW) -> DataFrame:
    """``rows.join(keyed, key)`` whose tasks stay bounded however few or frequent the keys are.

    ``keyed`` has one row per key of ``rows`` at most. With ``few`` keys it is broadcast, and the rows stay where they
    are. Without frequent keys it is a plain join. Otherwise a key of more than ``rows_per_salt`` rows is dealt over as many salts as it has such portions, by the
    hash of ``salt``, and its row of ``keyed`` is repeated for each; only the list of such keys is broadcast.
    """
    keys, most = rows.groupBy(key).count().agg(F.count("*"), F.max("count")).first()
    if keys <= few:
        return rows.join(F.broadcast(keyed), key)
    if most <= rows_per_salt:
        return rows.join(keyed.hint("merge"), key)  # wide rows, which Spark may take for small ones
    often = rows.groupBy(key).count().filter(F.col("count") > rows_per_salt)
    often = F.broadcast(often.select(key, F.ceil(F.col("count") / rows_per_salt).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    left = rows.join(often, key, "left").withColumn("__salt", F.pmod(F.xxhash64(salt), salts).cast("int")).drop("__salts")
    right = keyed.join(often, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left.join(right, [key, "__salt"]).drop("__salt")
