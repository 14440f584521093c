"""Order-dependent calculations that never put one whole group into one task.

A plain window over a key sorts all rows of that key in one task, which fails when a key
holds a third of a large table. Here rows are range-partitioned by key, order and tie
together, so that neither a frequent key nor a frequent order value makes a range larger;
the window runs inside (key, range), and what crosses a border travels through a small
table with a row per key and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipegrid.session import cut_lineage

ROWS_PER_BUCKET = 500_000


def in_ranges(
    df: DataFrame, by: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET, name: str = "__bucket", at_most: int | None = None
) -> DataFrame:
    """Add the number of a row's range; ranges follow each other in the order of the columns ``by``, nulls first.

    The rows are counted unless the caller knows how many there are ``at_most``. More than one range is written to the
    checkpoint folder, since ranges drawn anew would have other borders.
    """
    buckets = -(-(df.count() if at_most is None else at_most) // rows_per_bucket)
    if buckets <= 1:
        return df.withColumn(name, F.lit(0))
    return cut_lineage(df.repartitionByRange(buckets, *by).withColumn(name, F.spark_partition_id()))


def _per_bucket_prefix(df: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    """Sum of ``weight`` in all earlier buckets of the same key."""
    totals = df.groupBy(*keys, "__bucket").agg(F.sum(weight).alias("__w"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "__bucket", F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__before"))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, weight: str, out: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Inclusive running sum of ``weight`` per key in ``order`` (no ties in ``order``)."""
    work = in_ranges(df, [*keys, order], rows_per_bucket)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumn("__run", F.sum(weight).over(inside))
    prefix = _per_bucket_prefix(work, keys, F.col(weight))
    joined = _null_safe_join(work, prefix, [*keys, "__bucket"])
    return joined.withColumn(out, F.col("__run") + F.col("__before")).drop("__bucket", "__run", "__before")


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = None
    for c in on:
        term = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, "left").drop(*[f"__r_{c}" for c in on])


def row_number_in(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    out: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """1-based position of each row within its key, by (``order``, ``tie``)."""
    work = in_ranges(df, [*keys, order, tie], rows_per_bucket)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order, tie)
    work = work.withColumn("__rn", F.row_number().over(inside))
    prefix = _per_bucket_prefix(work, keys, F.lit(1))
    joined = _null_safe_join(work, prefix, [*keys, "__bucket"])
    return joined.withColumn(out, (F.col("__rn") + F.col("__before")).cast("bigint")).drop(
        "__bucket", "__rn", "__before"
    )


def lag_in(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    value: str,
    out: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Value of the previous row of the same key by (``order``, ``tie``); NULL for the first."""
    work = in_ranges(df, [*keys, order, tie], rows_per_bucket)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order, tie)
    work = work.withColumn("__lag", F.lag(value).over(inside)).withColumn("__rn", F.row_number().over(inside))
    last = work.groupBy(*keys, "__bucket").agg(F.max_by(value, F.struct(order, tie)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__bucket")
    carried = last.select(*keys, "__bucket", F.lag("__last").over(across).alias("__carried"))
    joined = _null_safe_join(work, carried, [*keys, "__bucket"])
    return joined.withColumn(
        out, F.when(F.col("__rn") == 1, F.col("__carried")).otherwise(F.col("__lag"))
    ).drop("__bucket", "__lag", "__rn", "__carried")
