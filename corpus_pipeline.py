"""A training-data pipeline: each stage takes the documents its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. Between
stages the result is written as Parquet to the shared checkpoint folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pipegrid.llm import decontam, mixing, packing, simhash, toxicity
from pipegrid.llm.common import read, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut of a network trained on the labelled documents among them."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates: four bits of 64 apart at most, over the operator's four-word shingles."""
    return simhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's template."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a Pfair schedule over their sources."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token rows in the order of the mixture, with the slots of their segments.

    Files are not read in the order they were written in, so the order is worked out again.
    """
    return packing.pack(mixing.texts_with_slots(docs), slots=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: The first stage is a trained network and the last a tokenizer: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    folder = shared_folder(spark)
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
