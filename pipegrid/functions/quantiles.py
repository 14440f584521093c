"""Exact quantiles with linear interpolation, without one task holding a whole column.

Small inputs (checked count) use the built-in exact ``percentile``. Larger ones count equal
values, put the counts of all columns into ranges of (column, value), and pick every wanted
rank inside its range. The number of jobs depends neither on the ranks nor on the columns,
and the driver gets a row per range and one per wanted rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipegrid.functions.ordered import ROWS_PER_BUCKET, in_ranges, running_sum

BUILTIN_VALUES = 2_000_000
CELLS_PER_RANGE = 2_000_000  # a value and its count take few bytes
BUILTIN_RANKS = 16  # with many probabilities the built-in is slower than counting values


def column_quantiles(
    df: DataFrame,
    columns: Sequence[Column],
    probabilities: Sequence[float],
    builtin_values: int = BUILTIN_VALUES,
    rows_per_bucket: int = CELLS_PER_RANGE,
) -> list[list[float | None]]:
    """Per column, the quantile at every probability; NULLs are ignored."""
    probs = [float(p) for p in probabilities]
    work = df.select(*[c.cast("double").alias(f"c{j}") for j, c in enumerate(columns)])
    names = work.columns
    counts = list(work.agg(*[F.count(c) for c in names]).first())
    if sum(counts) <= builtin_values and len(probs) <= BUILTIN_RANKS:
        # one folded literal instead of an expression per probability
        folded = F.split(F.lit(",".join(map(repr, probs))), ",").cast("array<double>")
        row = work.agg(*[F.percentile(c, folded).alias(c) for c in names]).first()
        return [row[c] if row[c] is not None else [None] * len(probs) for c in names]
    wanted = {
        j: sorted({r for p in probs for r in _ranks(p, n)}) for j, n in enumerate(counts) if n > 0
    }
    found = _select_ranks(work, wanted, sum(counts), rows_per_bucket)
    return [
        [_interpolate(p, n, found[j]) if n else None for p in probs] for j, n in enumerate(counts)
    ]


def _ranks(p: float, n: int) -> tuple[int, int]:
    position = p * (n - 1)
    return math.floor(position), math.ceil(position)


def _interpolate(p: float, n: int, values: dict[int, float]) -> float:
    position = p * (n - 1)
    low, high = math.floor(position), math.ceil(position)
    if low == high:
        return values[low]
    if values[low] == values[high]:
        return values[low]
    return (high - position) * values[low] + (position - low) * values[high]


def _select_ranks(work: DataFrame, wanted: dict[int, list[int]], at_most: int, rows_per_bucket: int) -> dict[int, dict[int, float]]:
    """Values at zero-based ranks per column."""
    if not wanted:
        return {}
    pairs = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"c{j}").alias("v")) for j in wanted])
    cells = work.select(F.inline(pairs)).filter(F.col("v").isNotNull()).groupBy("j", "v").agg(F.count("*").alias("n"))
    placed = in_ranges(cells, ["j", "v"], rows_per_bucket, "part", at_most)
    # where every range begins in its column: a row per range, and one more per column
    sizes = placed.groupBy("j", "part").agg(F.sum("n").alias("n")).collect()
    places, begin = [], dict.fromkeys(wanted, 0)
    pending = {j: list(ranks) for j, ranks in wanted.items()}
    for row in sorted(sizes, key=lambda r: (r.j, r.part)):
        first, begin[row.j] = begin[row.j], begin[row.j] + row.n
        while pending[row.j] and pending[row.j][0] < begin[row.j]:
            rank = pending[row.j].pop(0)
            places.append((row.j, row.part, rank, rank - first))
    ranks = work.sparkSession.createDataFrame(places, "j int, part int, rank long, inside long")
    # only ranges with a rank go on; there, a rank is met by the next count that goes beyond it
    some = placed.join(F.broadcast(ranks.select("j", "part").distinct()), ["j", "part"], "left_semi")
    upto = F.sum("n").over(Window.partitionBy("j", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    marks = some.select("j", "part", (2 * upto).alias("at"), "v", F.lit(None).cast("long").alias("rank"))
    marks = marks.unionByName(ranks.select("j", "part", (2 * F.col("inside") + 1).alias("at"), F.lit(None).cast("double").alias("v"), "rank"))
    behind = Window.partitionBy("j", "part").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    met = marks.withColumn("v", F.coalesce("v", F.last("v", ignorenulls=True).over(behind))).filter(F.col("rank").isNotNull())
    found: dict[int, dict[int, float]] = {j: {} for j in wanted}
    for row in met.select("j", "rank", "v").collect():
        found[row.j][row["rank"]] = row.v
    return found


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    builtin_values: int = BUILTIN_VALUES,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per key with a column per named probability, exact and skew-safe."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    if rows.count() <= builtin_values:
        return rows.groupBy(*keys).agg(
            *[F.percentile("__v", F.lit(float(p))).alias(name) for name, p in probabilities.items()]
        )
    counted = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    cumulated = running_sum(counted, keys, "__v", "__n", "__cum", rows_per_bucket)
    totals = rows.groupBy(*keys).agg(F.count("*").alias("__total"))
    renamed = totals.select(*[F.col(k).alias(f"__t_{k}") for k in keys], "__total")
    condition = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"__t_{k}"))
        condition = term if condition is None else condition & term
    joined = cumulated.join(renamed, condition).drop(*[f"__t_{k}" for k in keys])
    picks = []
    for i, p in enumerate(probabilities.values()):
        position = F.lit(float(p)) * (F.col("__total") - 1)
        picks += [
            F.min(F.when(F.col("__cum") > F.floor(position), F.col("__v"))).alias(f"__lo{i}"),
            F.min(F.when(F.col("__cum") > F.ceil(position), F.col("__v"))).alias(f"__hi{i}"),
            F.first(position - F.floor(position)).alias(f"__f{i}"),
        ]
    picked = joined.groupBy(*keys).agg(*picks)
    return picked.select(
        *keys,
        *[
            ((1 - F.col(f"__f{i}")) * F.col(f"__lo{i}") + F.col(f"__f{i}") * F.col(f"__hi{i}")).alias(name)
            for i, name in enumerate(probabilities)
        ],
    )
