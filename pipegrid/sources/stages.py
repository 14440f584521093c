"""Stage outputs and fitted components on disk, so that a rerun can skip them."""

from __future__ import annotations

import hashlib
import importlib
import pickle
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, Features


def stage_id(dataset: str, phase: str, seed: int, components: list[str]) -> str:
    text = ">".join([dataset, phase, str(seed), *components])
    return hashlib.md5(text.encode()).hexdigest()


class StageStore:
    """Parquet folders ``dataset=../phase=../stage=<id>`` below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, dataset: str, phase: str, seed: int, components: list[str]) -> str:
        return f"{self.root}/dataset={dataset}/phase={phase}/stage={stage_id(dataset, phase, seed, components)}"

    def read(self, path: str) -> Features | None:
        """The stage if it was written completely, else None."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        marker = hadoop.Path(f"{path}/_SUCCESS")
        if not marker.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(marker):
            return None
        try:
            df = self.spark.read.parquet(path)
        except AnalysisException:
            return None
        names = tuple(c for c in df.columns if c not in ("row_id", "label", "split", ARRAY))
        if names:
            return Features(df, names)
        return Features(df, (), df.select(F.size(ARRAY)).first()[0])

    def get_or_make(self, path: str, make) -> Features:
        found = self.read(path)
        if found is not None:
            return found
        made: Features = make()
        made.df.write.mode("overwrite").parquet(path)
        return replace(made, df=self.spark.read.parquet(path))


def save_component(spark: SparkSession, fitted, path: str) -> None:
    """Write a fitted component below ``path``: a row that says what it is, and its parts.

    ML models go by their own writer, tables as Parquet; what is left are small settings and arrays in one binary row.
    """
    fields = dict(vars(fitted))
    parts = {}
    for name, value in list(fields.items()):
        if isinstance(value, DataFrame):
            value.write.mode("overwrite").parquet(f"{path}/{name}")
        elif hasattr(value, "write") and hasattr(value, "transform"):
            value.write().overwrite().save(f"{path}/{name}")
        else:
            continue
        kind = type(value)
        parts[name] = "table" if isinstance(value, DataFrame) else f"{kind.__module__}:{kind.__name__}"
        del fields[name]
    row = [(type(fitted).__module__, type(fitted).__name__, bytearray(pickle.dumps((fields, parts))))]
    spark.createDataFrame(row, "module string, kind string, state binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/component")


def load_component(spark: SparkSession, path: str):
    """A component written by :func:`save_component`. Only load what you wrote yourself."""
    row = spark.read.parquet(f"{path}/component").first()
    fields, parts = pickle.loads(bytes(row["state"]))
    for name, kind in parts.items():
        if kind == "table":
            fields[name] = spark.read.parquet(f"{path}/{name}")
        else:
            module, model = kind.split(":")
            fields[name] = getattr(importlib.import_module(module), model).load(f"{path}/{name}")
    fitted = object.__new__(getattr(importlib.import_module(row["module"]), row["kind"]))
    for name, value in fields.items():
        object.__setattr__(fitted, name, value)
    return fitted
