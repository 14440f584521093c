"""Comparison with a baseline, and re-ordering of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.operators.columns import winner


def comparison(ours: DataFrame, baseline: DataFrame, names: tuple[str, str], digits: int = 3) -> DataFrame:
    """Counts and accuracies side by side, and who won (decided before rounding)."""
    joined = ours.select(
        "dataset", F.col("n_pipelines").alias("n_ours"), F.col("test_accuracy").alias("accuracy_ours")
    ).join(
        baseline.select(
            "dataset",
            F.col("n_pipelines").alias("n_baseline"),
            F.col("test_accuracy").alias("accuracy_baseline"),
        ),
        "dataset",
    )
    return joined.select(
        "dataset",
        "n_ours",
        "n_baseline",
        F.round("accuracy_ours", digits).alias("accuracy_ours"),
        F.round("accuracy_baseline", digits).alias("accuracy_baseline"),
        winner(F.col("accuracy_ours"), F.col("accuracy_baseline"), names).alias("winner"),
    )


def in_order_of(report: DataFrame, info: DataFrame, key: str, size: str) -> DataFrame:
    """The report in descending size of another table; a dataset without a report fails."""
    present = report.withColumn("__here", F.lit(True))
    joined = info.select(F.col(key).alias("__key"), F.col(size).alias(size)).join(
        present, F.col("__key") == F.col(key), "left"
    )
    checked = F.when(F.col("__here"), F.col(size)).otherwise(
        F.raise_error(F.concat(F.lit("no report for "), F.col("__key"))).cast("bigint")
    )
    return (
        joined.withColumn(size, checked)
        .orderBy(F.desc(size), F.asc("__key"))
        .drop("__key", "__here")
    )
