"""What the operators share: reading, row keys, connected components, shared scratch folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipegrid.session import cut_lineage, ensure_checkpoint_dir

CHUNK_BYTES = 1 << 20  #: a very long text is taken apart in pieces of about this size


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit key of a row. Rows with the same id and text share it, and a decision on the text alone with it."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the checkpoint folder, which every executor reaches."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"


def byte_chunks(data: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` that end at white space, so that no word is cut."""
    start = 0
    while len(data) - start > size:
        end = start + size
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of the ``a``-``b`` pairs, named by their smallest node.

    Labels move to the least neighbouring label and then to the label of that label, so that the number of rounds
    grows with the logarithm of a component's width. A node sends its label only when it is new: labels never rise, so
    neighbours know an old one. A node's own label and those sent to it meet in one aggregation. Each round ends in a
    reliable checkpoint. Joins are merges: one broadcast per round, each just small enough to be chosen, would gather on the
    driver. No edges: no rows.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = cut_lineage(first.withColumn("fresh", F.col("component") != F.col("node")))
    while not labels.filter("fresh").isEmpty():
        news = labels.filter("fresh").select(F.col("node").alias("b"), "component")
        sent = both.join(news.hint("merge"), "b").select(F.col("a").alias("node"), "component", F.lit(False).alias("own"))
        known = sent.unionByName(labels.select("node", "component", F.lit(True).alias("own")))
        moved = known.groupBy("node").agg(F.min("component").alias("moved"), F.min(F.when(F.col("own"), F.col("component"))).alias("was"))
        heads = moved.select(F.col("node").alias("moved"), F.col("moved").alias("head"))
        jumped = moved.join(heads.hint("merge"), "moved").select("node", "was", F.least("moved", "head").alias("component"))
        labels = cut_lineage(jumped.select("node", "component", (F.col("component") != F.col("was")).alias("fresh")))
    return labels.select("node", "component")
