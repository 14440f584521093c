"""Binary label encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOWED = ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def encode_label(df: DataFrame, column: str, out: str = "label") -> DataFrame:
    """Smallest class becomes 0, the other 1; anything but two classes is an error."""
    kind = dict(df.dtypes)[column]
    if kind not in ALLOWED:
        raise TypeError(f"label type {kind} is not string, boolean or numeric")
    # two classes exactly: min and max differ and every value is one of them. No distinct
    # set is collected, so a label column with billions of values fails cheaply.
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = ends["low"], ends["high"]
    if low is None or low == high:
        raise ValueError("label needs two classes")
    value = F.col(column)
    odd = df.filter(value.isNull() | ((value != F.lit(low)) & (value != F.lit(high)))).limit(1).count()
    if odd:
        raise ValueError("label has more than two classes or NULL")
    return df.withColumn(out, F.when(value == F.lit(low), 0).otherwise(1))
