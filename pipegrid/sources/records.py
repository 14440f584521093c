"""Run records: JSON files with an explicit schema, the file name carrying meaning.

Readers give (file_path, file_name, content); the parsers work on that shape, so they
also serve tables that already hold the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY_SCHEMA = """
last_task array<string>, task_id string, error string,
accuracy struct<train: double, test: double>, balanced_accuracy struct<train: double, test: double>,
pipeline struct<imputer: string, scaler: string, feature_preprocessor: string, classifier: string>
"""
METRICS = ("accuracy", "balanced_accuracy")


def read_record_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below ``path``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("value").alias("content"),
    )


def status_of(file_name: Column) -> Column:
    """What a record file reports, by its name; NULL for other files."""
    return (
        F.when(file_name.contains("run_summary"), "success")
        .when(file_name.contains("FAILURE"), "failed")
        .when(file_name.contains("TIMEOUT"), "timeout")
    )


def is_train_record(file_name: Column) -> Column:
    return (
        ~file_name.contains("_incumbent") & file_name.endswith("json") & status_of(file_name).isNotNull()
    )


def parse_run_records(files: DataFrame, keep: list[str]) -> DataFrame:
    """Run history rows; stage names and metrics are NULL unless the run succeeded."""
    rows = files.filter(is_train_record(F.col("file_name"))).select(
        *keep,
        status_of(F.col("file_name")).alias("status"),
        F.from_json("content", SUMMARY_SCHEMA).alias("r"),
    )
    ok = F.col("status") == "success"
    return rows.select(
        *keep,
        *[
            F.when(ok, F.col(f"r.pipeline.{k}")).alias(k)
            for k in ("imputer", "scaler", "feature_preprocessor", "classifier")
        ],
        *[F.when(ok, F.col(f"r.{m}.train")).alias(f"train_{m}") for m in METRICS],
        *[F.when(ok, F.col(f"r.{m}.test")).alias(f"valid_{m}") for m in METRICS],
        F.when(ok, F.get("r.last_task", F.lit(0))).otherwise(F.col("r.task_id")).alias("last_task"),
        "status",
    )


def parse_run_times(files: DataFrame, keep: list[str]) -> DataFrame:
    """Component and total seconds of ``<component>...run_time.json`` files.

    The component is the file name up to the first double underscore, matched exactly.
    """
    return files.filter(F.col("file_name").endswith("run_time.json")).select(
        *keep,
        F.split_part("file_name", F.lit("__"), F.lit(1)).alias("component"),
        F.get_json_object("content", "$.total_seconds").cast("double").alias("seconds"),
    )


def explode_checkpoints(files: DataFrame, keep: list[str]) -> DataFrame:
    """A JSON map of checkpoint -> cumulative seconds as rows in their order."""
    entries = F.map_entries(F.from_json("content", "map<string, double>"))
    return files.select(*keep, F.posexplode(entries).alias("position", "e")).select(
        *keep, "position", F.col("e.key").alias("checkpoint"), F.col("e.value").alias("seconds")
    )


# fixed values: the keys under which the baseline history keeps its choices
CHOICES = {
    "classifier": "classifier:__choice__",
    "feature_preprocessor": "feature_preprocessor:__choice__",
    "scaler": "data_preprocessor:feature_type:numerical_transformer:rescaling:__choice__",
}


def baseline_choice(files: DataFrame, rank: str, keep: list[str]) -> DataFrame:
    """The chosen components of the configuration with id ``rank - 1``."""
    parsed = F.from_json("content", "struct<configs: map<string, map<string, string>>>")
    config = F.try_element_at(parsed["configs"], (F.col(rank) - 1).cast("string"))
    return files.select(*keep, rank, config.alias("config")).select(
        *keep,
        F.col(rank).alias("id_in_leaderboard"),
        (F.col(rank) - 1).alias("id_in_run_history"),
        *[F.try_element_at("config", F.lit(key)).alias(name) for name, key in CHOICES.items()],
    )


def parse_config_name(df: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """``problem-ts_N-deg_D-noise_X-seed_S`` to columns; another shape fails the run."""
    pieces = F.split(F.col(name), "-")
    checked = F.when(F.size(pieces) == 5, pieces).otherwise(
        F.raise_error(F.concat(F.lit("not a five-part configuration name: "), F.col(name)))
    )

    def last(i: int) -> Column:
        return F.element_at(F.split(F.col("__p")[i], "_"), -1)

    return df.withColumn("__p", checked).select(
        F.col("__p")[0].alias("problem_name"),
        last(1).cast("int").alias("training_size"),
        last(2).cast("int").alias("degree"),
        last(3).cast("double").alias("noise"),
        last(4).cast("int").alias("seed"),
        *keep,
    )


def collect_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation summaries below ``path``: folder name to columns, file to a row."""
    files = read_record_files(spark, path).filter(
        F.col("file_name").endswith("summary.json") & F.col("file_name").contains("Evaluation")
    )
    rows = files.select(
        F.element_at(F.split("file_path", "/"), -2).alias("name"),
        F.from_json("content", "regret double, mse double, regressor string").alias("e"),
    ).select("name", "e.*")
    return parse_config_name(rows, "name", ["regressor", "regret", "mse"])
