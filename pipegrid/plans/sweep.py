"""Reports over an experiment sweep: pivots, box-plot numbers and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.functions.ordered import ROWS_PER_BUCKET, lag_in
from pipegrid.functions.quantiles import grouped_quantiles


# fixed values: the stages of an experiment as they occur in file names
SOLVING = "GenerateOptimalSolutionsAndObjectiveValues__"
MAKING = "SyntheticDataGenerator__"


def elapsed(cumulative: DataFrame, run: str, order: str, tie: str, seconds: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Cumulative clock to seconds per step; the first step keeps its value."""
    lagged = lag_in(cumulative, [run], order, tie, seconds, "__before", rows_per_bucket)
    return lagged.withColumn("elapsed", F.col(seconds) - F.coalesce("__before", F.lit(0.0))).drop("__before")


def pivot_regret(scores: DataFrame, keys: list[str], degrees: list[int]) -> DataFrame:
    """Rows by seed (and ``keys``), columns by degree; a duplicate entry is an error."""

    def cell(d: int):
        mine = F.col("degree") == d
        value = F.max(F.when(mine, F.col("regret")))
        return (
            F.when(F.count_if(mine) <= 1, value)
            .otherwise(F.raise_error(F.lit("duplicate entries for one seed and degree")).cast("double"))
            .alias(f"degree_{d}")
        )

    return scores.groupBy(*keys, "seed").agg(*[cell(d) for d in degrees])


def box_statistics(scores: DataFrame, keys: list[str], value: str, **limits) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, and the number of outliers."""
    quartiles = grouped_quantiles(scores, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, **limits)
    fenced = quartiles.withColumn("__reach", 1.5 * (F.col("q3") - F.col("q1")))
    joined = scores.join(fenced, keys)
    v = F.col(value)
    inside = v.between(F.col("q1") - F.col("__reach"), F.col("q3") + F.col("__reach"))
    # one value per group, so max() is just a way to carry it
    return joined.groupBy(*keys).agg(
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        # a whisker never ends inside the box
        F.least(F.min(F.when(inside, v)), F.max("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, v)), F.max("q3")).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def box_outliers(scores: DataFrame, keys: list[str], value: str, **limits) -> DataFrame:
    """The values beyond the whiskers, one per row."""
    quartiles = grouped_quantiles(scores, keys, value, {"q1": 0.25, "q3": 0.75}, **limits)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    beyond = (v < F.col("q1") - reach) | (v > F.col("q3") + reach)
    return scores.join(quartiles, keys).filter(beyond).select(*keys, v)


def stage_seconds(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Generation and solving seconds per configuration, by stage name in the file name."""
    solving = F.col("file_name").contains(SOLVING)
    making = ~solving & F.col("file_name").contains(MAKING)
    return runs.filter(F.col("file_name").endswith("run_time.json")).groupBy(*keys).agg(
        F.max(F.when(making, F.col("seconds"))).alias("generation_sec"),
        F.max(F.when(solving, F.col("seconds"))).alias("solution_sec"),
    )


def cost_report(costs: DataFrame, keys: list[str], n_models: int = 5, digits: int = 2) -> DataFrame:
    """Seconds run and saved: shared stages ran once instead of once per model."""
    shared = n_models - 1
    summed = costs.groupBy(*keys).agg(
        F.sum("total_sec").alias("total_sec"),
        (F.sum("generation_sec") * shared).alias("saved_generation_sec"),
        (F.sum("solution_sec") * shared).alias("saved_solution_sec"),
    )
    saved = F.col("saved_generation_sec") + F.col("saved_solution_sec")
    return summed.withColumn("saved_percent", saved / (F.col("total_sec") + saved) * 100.0).select(
        *keys,
        *[
            F.round(c, digits).alias(c)
            for c in ("total_sec", "saved_generation_sec", "saved_solution_sec", "saved_percent")
        ],
    )
