"""How much work sharing intermediate results saved.

``uses`` counts successful pipelines per component, ``stage_runs`` holds the runs that
really happened; the difference is what was avoided.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipegrid.functions.quantiles import grouped_quantiles

SAVED_KINDS = ("imputer", "scaler", "feature_preprocessor")


def geometric_mean(value: Column) -> Column:
    """exp(mean(ln x)); a value that is not positive is an error, not a NULL."""
    positive = F.when(value > 0, value).when(value.isNull(), None).otherwise(
        F.raise_error(F.lit("geometric mean needs positive values")).cast("double")
    )
    return F.exp(F.avg(F.ln(positive)))


def component_uses(history: DataFrame, by: list[str]) -> DataFrame:
    """Successful pipelines per component: stages unpivoted, one count for all of them."""
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("component")) for k in SAVED_KINDS])
    return (
        history.filter(F.col("status") == "success")
        .select(*by, F.inline(named))
        .filter(F.col("component").isNotNull())
        .groupBy(*by, "kind", "component")
        .agg(F.count("*").alias("used"))
    )


def component_times(
    stage_runs: DataFrame, by: list[str], func: str | Callable[[Column], Column] = "mean"
) -> DataFrame:
    """Typical seconds and number of runs per component.

    ``func`` is mean, median, geometric_mean, or any function from a column to an
    aggregate column.
    """
    keys = [*by, "component"]
    if func == "median":
        counts = stage_runs.groupBy(*keys).agg(F.count("*").alias("runs"))
        return grouped_quantiles(stage_runs, keys, "seconds", {"run_time": 0.5}).join(counts, keys)
    known = {"mean": F.avg, "geometric_mean": geometric_mean}
    aggregate = func if callable(func) else known[func]
    return stage_runs.groupBy(*keys).agg(
        aggregate(F.col("seconds")).alias("run_time"), F.count("*").alias("runs")
    )


def component_savings(uses: DataFrame, times: DataFrame, by: list[str]) -> DataFrame:
    """Seconds saved and runs avoided per component; a component never run has time 0."""
    joined = uses.join(times, [*by, "component"], "left").na.fill(0, ["runs"]).na.fill(0.0, ["run_time"])
    return joined.select(
        *by,
        "kind",
        "component",
        (F.col("run_time") * F.col("used") - F.col("run_time") * F.col("runs")).alias("saved_time"),
        (F.col("used") - F.col("runs")).alias("avoided_runs"),
    )


def savings_per_kind(savings: DataFrame, by: list[str]) -> DataFrame:
    return savings.groupBy(*by, "kind").agg(
        F.sum("saved_time").alias("total_saved_time"), F.sum("avoided_runs").alias("total_avoided_runs")
    )


def dataset_totals(history: DataFrame, by: list[str]) -> DataFrame:
    """Seconds over all runs, and stages used by successful ones."""
    ok = F.col("status") == "success"
    used = [F.count_if(ok & F.col(k).isNotNull()) for k in SAVED_KINDS]
    return history.groupBy(*by).agg(
        F.sum("seconds").alias("run_time"), (used[0] + used[1] + used[2]).alias("component_count")
    )


def savings_report(per_kind: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """One row per dataset: saved seconds and avoided runs per kind, with percentages."""

    def of(kind: str, value: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(value))), F.lit(0))

    wide = per_kind.groupBy(*by).agg(
        *[of(k, "total_saved_time").cast("double").alias(f"{k}_saved_sec") for k in SAVED_KINDS],
        *[of(k, "total_avoided_runs").alias(f"{k}_avoided_runs") for k in SAVED_KINDS],
    )
    saved = sum((F.col(f"{k}_saved_sec") for k in SAVED_KINDS[1:]), F.col(f"{SAVED_KINDS[0]}_saved_sec"))
    avoided = sum((F.col(f"{k}_avoided_runs") for k in SAVED_KINDS[1:]), F.col(f"{SAVED_KINDS[0]}_avoided_runs"))
    return totals.join(wide, by).select(
        *by,
        F.col("run_time").alias("total_run_sec"),
        *[f"{k}_saved_sec" for k in SAVED_KINDS],
        (saved / (saved + F.col("run_time")) * 100.0).alias("saved_percent"),
        F.col("component_count").alias("total_components"),
        *[f"{k}_avoided_runs" for k in SAVED_KINDS],
        (avoided / F.col("component_count") * 100.0).alias("avoided_percent"),
    )


def log_report(
    runs: DataFrame, stages: DataFrame, by: list[str], func: str | Callable[[Column], Column] = "mean"
) -> DataFrame:
    """The report of a grid's own log: ``runs`` and ``stages`` as its journal holds them.

    A component's times are its successful stage records under the same ``by`` columns (dataset, phase), so stages that
    a resumed grid computed again count again. Groups without a successful run have no row.
    """
    saved_kinds = stages.filter((F.col("status") == "success") & F.col("kind").isin(*SAVED_KINDS))
    per_component = component_savings(component_uses(runs, by), component_times(saved_kinds, by, func), by)
    return savings_report(savings_per_kind(per_component, by), dataset_totals(runs, by), by)


def geometric_means(report: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    return report.agg(*[F.round(geometric_mean(F.col(c)), digits).alias(c) for c in columns])
