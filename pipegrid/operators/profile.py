"""Dataset profile: size and missing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_missing(name: str, dtype: str):
    test = F.col(name).isNull()
    return test | F.isnan(name) if dtype in ("double", "float") else test


def dataset_profile(df: DataFrame, columns: list[str], dataset: str) -> DataFrame:
    """One row: columns, rows, missing cells, columns with missing, rows with missing."""
    types = dict(df.dtypes)
    missing = {c: is_missing(c, types[c]) for c in columns}
    any_missing = reduce(lambda a, b: a | b, missing.values())
    counts = df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(any_missing).alias("n_rows_with_nans"),
        *[F.count_if(m).alias(f"m_{j}") for j, m in enumerate(missing.values())],
    )
    cells = [F.col(f"m_{j}") for j in range(len(columns))]
    return counts.select(
        F.lit(dataset).alias("ds_name"),
        F.lit(len(columns)).cast("bigint").alias("n_cols"),
        "n_rows",
        reduce(lambda a, b: a + b, cells).alias("n_nans"),
        reduce(lambda a, b: a + b, [F.when(c > 0, 1).otherwise(0) for c in cells])
        .cast("bigint")
        .alias("n_cols_with_nans"),
        "n_rows_with_nans",
    )


def dataset_sizes(df: DataFrame, dataset: str, n_features: int, known: list[str]) -> DataFrame:
    """Rows per dataset with the feature count and an X / - flag for known names."""
    return (
        df.groupBy(F.col(dataset).alias("name"))
        .agg(F.count("*").alias("n_instances"))
        .select(
            "name",
            F.lit(n_features).cast("bigint").alias("n_features"),
            "n_instances",
            F.when(F.col("name").isin(known), "X").otherwise("-").alias("in_baseline"),
        )
    )
