"""Run history, leaderboard and summaries.

Best-of-group questions are answered by ``max_by`` aggregates, which combine before the
shuffle; no group is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ["imputer", "scaler", "feature_preprocessor", "classifier"]


def ranked(history: DataFrame, metric: str = "accuracy", tie: str = "pipeline_id") -> DataFrame:
    """Best validation score first, missing scores last."""
    return history.orderBy(F.desc_nulls_last(f"valid_{metric}"), F.asc(tie))


def incumbents(
    history: DataFrame, by: list[str], metric: str = "accuracy", tie: str = "pipeline_id", keep: list[str] | None = None
) -> DataFrame:
    """The best successful run per group; a group without success gives no row."""
    keep = keep or [c for c in history.columns if c not in by]
    best = (
        history.filter((F.col("status") == "success") & F.col(f"valid_{metric}").isNotNull())
        .groupBy(*by)
        .agg(F.min_by(F.struct(*keep), F.struct(-F.col(f"valid_{metric}"), F.col(tie))).alias("b"))
    )
    return best.select(*by, "b.*")


def train_summary(history: DataFrame, by: list[str], metric: str = "accuracy", tie: str = "pipeline_id") -> DataFrame:
    """Run counts by status and the best pipeline with its scores."""
    ok = F.col("status") == "success"
    value = F.col(f"valid_{metric}")
    best = F.struct(*STAGES, F.col(f"train_{metric}"), value.alias(f"validation_{metric}"))
    # NULL ordering: runs without a score are left out of the choice
    order = F.when(ok & value.isNotNull(), F.struct(-value, F.col(tie)))
    return (
        history.groupBy(*by)
        .agg(
            F.count("*").alias("n_runs"),
            F.count_if(ok).alias("successful"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            F.count_if(F.col("status") == "timeout").alias("timeout"),
            F.min_by(best, order).alias("b"),
        )
        .select(*by, "n_runs", "successful", "failed", "timeout", "b.*")
    )


def test_summary(records: DataFrame, by: list[str], metric: str = "accuracy") -> DataFrame:
    """The single refit of the incumbent per group; more than one record is an error."""
    one = records.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.first(F.struct(*STAGES, f"train_{metric}", f"test_{metric}")).alias("r"),
    )
    checked = F.when(F.col("n") == 1, F.col("r")).otherwise(
        F.raise_error(F.lit("more than one record for an incumbent"))
    )
    return one.withColumn("r", checked).select(*by, "r.*")


def all_test_summaries(records: DataFrame, folder: str, metric: str = "accuracy", suffix: str = "_incumbent") -> DataFrame:
    """One row per dataset; its name is the folder name without the suffix."""
    name = F.expr(f"substring({folder}, 1, length({folder}) - {len(suffix)})")
    rows = records.filter(F.col(folder).contains(suffix)).withColumn("dataset", name)
    order = F.struct("file_name")
    picked = rows.groupBy("dataset").agg(
        F.min_by(F.struct("classifier", "feature_preprocessor", "scaler", "imputer", f"test_{metric}"), order).alias("r")
    )
    return picked.select("dataset", "r.*")


def status_counts(history: DataFrame, by: list[str]) -> DataFrame:
    return history.groupBy(*by).agg(
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "timeout").alias("timeout"),
    )
