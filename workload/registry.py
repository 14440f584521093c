"""Where the checked queries are collected, each with its SQL twin if it has one."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipegrid.session import hold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Cache a table that a query reads more than once; released when the next query starts."""
    _KEPT.append(hold(df))
    return _KEPT[-1]


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            while _KEPT:
                _KEPT.pop().unpersist()
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(column: Column | str, name: str | None = None) -> Column:
    """Six digits, without a negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    rounded = F.round(column, 6) + F.lit(0.0)
    return rounded.alias(name) if name else rounded


def s6(expression: str, name: str) -> str:
    """The SQL twin of :func:`r6`."""
    return f"round(cast({expression} as double), 6) + 0.0 as {name}"
