"""Arrow helpers: array columns as numpy blocks, and sums of per-partition blocks.

``block_map`` turns an array column into another one, a batch at a time, without copying
rows into Python objects. ``partial_sums`` gives the sum over all rows of a numpy
statistic: one vector per partition, summed in levels of at most ``FAN_IN`` vectors per
task, until the driver receives no more than that many.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_block(values: pa.Array, dim: int) -> np.ndarray:
    """A list<double> Arrow array of fixed length ``dim`` as an (n, dim) numpy block."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(values) * dim:
        raise ValueError(f"expected arrays of length {dim} without NULL rows")
    return np.asarray(flat, dtype=np.float64).reshape(len(values), dim)


def from_block(block: np.ndarray) -> pa.Array:
    block = np.ascontiguousarray(block, dtype=np.float64)
    offsets = np.arange(0, block.size + 1, block.shape[1] or 1, dtype=np.int32)
    if block.shape[1] == 0:
        offsets = np.zeros(len(block) + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(block.reshape(-1)))


def block_map(fn: Callable[[np.ndarray], np.ndarray], array: Column, dim: int) -> Column:
    """Apply ``fn: (n, dim) -> (n, k)`` to an array column; the result is array<double>."""

    @F.arrow_udf("array<double>")
    def run(values: pa.Array) -> pa.Array:
        return from_block(fn(as_block(values, dim)))

    return run(array)


def block_score(fn: Callable[[np.ndarray], np.ndarray], array: Column, dim: int) -> Column:
    """Apply ``fn: (n, dim) -> (n,)`` to an array column; the result is a double."""

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(np.asarray(fn(as_block(values, dim)), dtype=np.float64))

    return run(array)


FAN_IN = 32  # vectors that one merge task holds, and that the driver gets at most
UNMERGED_DOUBLES = 2_000_000  # doubles that the driver gets without a merge
UNKNOWN_BYTES = 1 << 60


def expected_tasks(df: DataFrame) -> int:
    """An upper estimate of ``df``'s partitions, from its plan alone: no job runs for it.

    Scans have as many tasks as the input has splits, shuffles as many as the session sets.
    """
    conf = df.sparkSession.conf
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    scans = -(-min(size, UNKNOWN_BYTES) // split) if size < UNKNOWN_BYTES else 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(scans, int(conf.get("spark.sql.shuffle.partitions")), cores)


def cached_tasks(df: DataFrame) -> int | None:
    """The partitions of a cached table; None for any other."""
    level = df.storageLevel
    if not (level.useMemory or level.useDisk):
        return None
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def merge_levels(df: DataFrame, length: int | None = None) -> int:
    """How many levels of merging leave the driver at most ``FAN_IN`` vectors.

    A cached table's partitions are known: if these are few and their vectors of ``length`` doubles are small, there is
    no merging and no shuffle.
    """
    known = cached_tasks(df) if length is not None else None
    if known is not None and known <= FAN_IN and known * length <= UNMERGED_DOUBLES:
        return 0
    tasks, levels = expected_tasks(df), 0
    while tasks > FAN_IN:
        tasks, levels = -(-tasks // FAN_IN), levels + 1
    return levels


def partition_fold(
    df: DataFrame,
    arrays: dict[str, int],
    scalars: Sequence[str],
    start: Callable[[], object],
    step: Callable[[object, dict[str, np.ndarray]], object],
    finish: Callable[[object], np.ndarray],
    length: int,
    combine: str = "sum",
) -> np.ndarray:
    """Fold the batches of each partition into a state, and combine the finished vectors.

    ``step`` gets a dict of numpy blocks (array columns) and vectors (scalar columns).
    ``combine`` is sum or min.
    """
    neutral = 0.0 if combine == "sum" else math.inf
    merge = np.add if combine == "sum" else np.minimum

    def per_partition(batches):
        state, seen = None, False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            data = {c: as_block(batch.column(c), d) for c, d in arrays.items()}
            data.update({c: batch.column(c).to_numpy(zero_copy_only=False) for c in scalars})
            state = step(state if seen else start(), data)
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([from_block(finish(state)[None, :])], names=["v"])

    parts = df.select(*arrays, *scalars).mapInArrow(per_partition, "v array<double>")
    parts = _merged(parts, length, merge, neutral, merge_levels(df, length))
    total = np.full(length, neutral)
    for chunk in parts.toArrow().column("v").chunks:
        for row in as_block(chunk, length):
            total = merge(total, row)
    return total


def partial_sums(
    df: DataFrame,
    arrays: dict[str, int],
    scalars: Sequence[str],
    fn: Callable[[dict[str, np.ndarray]], np.ndarray],
    length: int,
    combine: str = "sum",
) -> np.ndarray:
    """Combine ``fn(batch)``, a vector of ``length`` doubles, over all batches of ``df``."""
    merge = np.add if combine == "sum" else np.minimum
    return partition_fold(
        df,
        arrays,
        scalars,
        lambda: None,
        lambda state, data: fn(data) if state is None else merge(state, fn(data)),
        lambda state: state,
        length,
        combine,
    )


def _merged(parts: DataFrame, length: int, merge, neutral: float, levels: int) -> DataFrame:
    """``levels`` rounds of merging, each of ``FAN_IN`` neighbouring vectors at most into one."""

    def merge_group(key: tuple, table: pa.Table) -> pa.Table:
        total = np.full(length, neutral)
        for chunk in table.column("v").chunks:
            for row in as_block(chunk, length):
                total = merge(total, row)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "v": from_block(total[None, :])})

    if levels:
        parts = parts.withColumn("g", F.spark_partition_id().cast("bigint"))
    for _ in range(levels):
        keyed = parts.withColumn("g", F.floor(F.col("g") / FAN_IN))
        parts = keyed.groupBy("g").applyInArrow(merge_group, "g bigint, v array<double>")
    return parts.select("v")
