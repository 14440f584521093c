"""The run log: one row per attempt."""

from __future__ import annotations

import hashlib
import threading

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipegrid.functions.ordered import ROWS_PER_BUCKET, row_number_in

RUN_LOG_SCHEMA = """
pipeline_id string, dataset string, phase string, imputer string, scaler string, feature_preprocessor string,
classifier string, status string, train_accuracy double, valid_accuracy double, train_balanced_accuracy double,
valid_balanced_accuracy double, seconds double, started_at double, error string, seed long, data_version string
"""

STAGE_LOG_SCHEMA = """
dataset string, phase string, kind string, component string, chain string, status string, seconds double,
started_at double
"""


def version_of(df: DataFrame) -> str:
    """A name for a table's rows, whatever their order: their number, and the sum and the bits of their hashes."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    facts = df.select(row.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(20,0)")), F.bit_xor("h")).first()
    return hashlib.md5(":".join([*map(str, facts), str(df.dtypes)]).encode()).hexdigest()


class Journal:
    """Run and stage records of a grid, each written as soon as it is known.

    Below ``root`` lie ``runs`` and ``stages``, Parquet folders that grow by a file per record. Without a root, records
    are kept in memory only.
    """

    def __init__(self, spark: SparkSession, root: str | None):
        self.spark, self.root = spark, root and root.rstrip("/")
        self.runs: list[tuple] = []
        self.stages: list[tuple] = []
        self.lock = threading.Lock()

    def add_run(self, record: tuple) -> None:
        self._add(self.runs, "runs", record, RUN_LOG_SCHEMA)

    def add_stage(self, record: tuple) -> None:
        self._add(self.stages, "stages", record, STAGE_LOG_SCHEMA)

    def _add(self, kept: list[tuple], folder: str, record: tuple, schema: str) -> None:
        if self.root is not None:
            self.spark.createDataFrame([record], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{folder}")
        with self.lock:
            kept.append(record)

    def read_runs(self) -> DataFrame:
        return self._read("runs", self.runs, RUN_LOG_SCHEMA)

    def read_stages(self) -> DataFrame:
        return self._read("stages", self.stages, STAGE_LOG_SCHEMA)

    def _read(self, folder: str, kept: list[tuple], schema: str) -> DataFrame:
        if self.root is None:
            return self.spark.createDataFrame(kept, schema)
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], schema)

    def runs_of(self, dataset: str, phase: str, seed: int, data_version: str | None) -> DataFrame:
        """The records of one grid: the same name and phase, seed and data."""
        same = F.col("data_version").eqNullSafe(F.lit(data_version))
        return self.read_runs().filter((F.col("dataset") == dataset) & (F.col("phase") == phase) & (F.col("seed") == seed) & same)

    def succeeded(self, dataset: str, phase: str, seed: int, data_version: str | None) -> set[str]:
        """Pipelines that need no further attempt."""
        done = self.runs_of(dataset, phase, seed, data_version).filter("status = 'success'")
        return {r["pipeline_id"] for r in done.select("pipeline_id").distinct().collect()}

    def attempts(self) -> DataFrame:
        """The run log with every task's attempts numbered in time order."""
        return number_attempts(
            self.read_runs(), ["dataset", "phase", "seed", "data_version", "pipeline_id", "status"], "started_at", "pipeline_id"
        )


def number_attempts(
    runs: DataFrame, keys: list[str], order: str, tie: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Number repeated failures or timeouts of the same task in time order."""
    return row_number_in(runs, keys, order, tie, "attempt", rows_per_bucket)


def first_stage_runs(log: DataFrame, by: list[str], order: str, tie: str) -> DataFrame:
    """Per distinct stage prefix, the run that had to compute it (the others reused it)."""
    kinds = ["imputer", "scaler", "feature_preprocessor"]
    out = None
    for i, kind in enumerate(kinds):
        prefix = kinds[: i + 1]
        first = (
            log.filter(F.col(kind).isNotNull())
            .groupBy(*by, *prefix)
            .agg(F.min_by("seconds", F.struct(order, tie)).alias("seconds"))
            .select(*by, F.lit(kind).alias("kind"), F.col(kind).alias("component"), "seconds")
        )
        out = first if out is None else out.unionByName(first)
    return out
