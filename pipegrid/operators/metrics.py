"""Accuracy and balanced accuracy by split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(predictions: DataFrame, by: list[str], digits: int = 5) -> DataFrame:
    """Share of rows with y_pred = label."""
    hit = (F.col("y_pred") == F.col("label")).cast("double")
    return predictions.groupBy(*by).agg(F.round(F.avg(hit), digits).alias("accuracy"))


def balanced_accuracy(predictions: DataFrame, by: list[str], digits: int = 5) -> DataFrame:
    """Mean recall over the classes that occur."""
    return scores(predictions, by, digits).drop("accuracy")


def scores(predictions: DataFrame, by: list[str], digits: int = 5) -> DataFrame:
    """Both measures from one shuffle: the rows shrink to (by, label) before they move."""
    hit = (F.col("y_pred") == F.col("label")).cast("bigint")
    recall = predictions.groupBy(*by, "label").agg(F.sum(hit).alias("hits"), F.count("*").alias("n"))
    return recall.groupBy(*by).agg(
        F.round(F.sum("hits") / F.sum("n"), digits).alias("accuracy"),
        F.round(F.avg(F.col("hits") / F.col("n")), digits).alias("balanced_accuracy"),
    )
