"""Feature tables from files, and the files written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipegrid.frame import Features, from_columns


def feature_schema(columns: list[str], key: str = "row_id") -> T.StructType:
    """The declared schema: a key and doubles. Nothing is inferred from the data."""
    return T.StructType(
        [T.StructField(key, T.LongType()), *[T.StructField(c, T.DoubleType()) for c in columns]]
    )


def missing_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and NULL both mean missing; keep one of them."""
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in columns})


def load_side(spark: SparkSession, x_path: str, y_path: str, columns: list[str], split: str) -> DataFrame:
    """One side of a split: features and target, paired by their key."""
    x = spark.read.schema(feature_schema(columns)).csv(x_path, header=True)
    y = spark.read.schema("row_id bigint, label int").csv(y_path, header=True)
    return missing_to_null(x, columns).join(y, "row_id").withColumn("split", F.lit(split))


def load_split(spark: SparkSession, folder: str, columns: list[str], phase: str = "train") -> Features:
    """``<folder>/<phase>_phase/{x,y}_{train,valid|test}.csv`` as one table with a split column."""
    other = "valid" if phase == "train" else "test"
    base = f"{folder}/{phase}_phase"
    train = load_side(spark, f"{base}/x_train.csv", f"{base}/y_train.csv", columns, "train")
    held_out = load_side(spark, f"{base}/x_{other}.csv", f"{base}/y_{other}.csv", columns, "test")
    return from_columns(train.unionByName(held_out), columns)


def save_split(features: Features, folder: str, phase: str = "train") -> None:
    """The same layout, written as CSV folders."""
    other = "valid" if phase == "train" else "test"
    for split, name in (("train", "train"), ("test", other)):
        side = features.df.filter(F.col("split") == split)
        base = f"{folder}/{phase}_phase"
        side.select("row_id", *features.names).write.mode("overwrite").csv(f"{base}/x_{name}.csv", header=True)
        side.select("row_id", "label").write.mode("overwrite").csv(f"{base}/y_{name}.csv", header=True)


def load_with_target(spark: SparkSession, path: str, columns: list[str], target: str = "target") -> DataFrame:
    """One table with features and a target column."""
    schema = T.StructType([*feature_schema(columns).fields, T.StructField(target, T.IntegerType())])
    return missing_to_null(spark.read.schema(schema).csv(path, header=True), columns)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
