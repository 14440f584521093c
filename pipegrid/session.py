"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, name: str = "pipegrid") -> SparkSession:
    """A session for tests and the bench; on a cluster the session is given."""
    return (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the library to Python workers, once per application.

    The archive lies on the driver, whose file server hands it out. Workers of a local master start in the driver's
    working directory, which needn't be this one, so they get it too.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="pipegrid-"), "pipegrid.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        for top in (package, os.path.join(root, "workload")):
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        packed.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one only in local mode."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return
    if context.getCheckpointDir() is not None:
        return
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pipegrid-checkpoint-"))


def cut_lineage(df: DataFrame, free_shuffles: bool = False, once: bool = False) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back from there.

    A checkpoint computes what follows the last shuffle twice; ``once`` keeps it on executors in between, for costly tasks.
    ``free_shuffles`` deletes the shuffle files behind ``df`` at once, instead of when the driver happens to collect its garbage;
    ``df`` itself must not be read again then. Those of cached tables stay.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if once:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    written = df.checkpoint(eager=True)
    behind = df._jdf.queryExecution().toRdd() if free_shuffles else None
    if once:
        df.unpersist()
    if free_shuffles:
        behind.cleanShuffleDependencies(True)
    return written


def hold(df: DataFrame) -> DataFrame:
    """Cache on executors, spilling to disk; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def is_view_of_cache(df: DataFrame) -> bool:
    """Whether ``df`` only filters and projects something cached, so that caching it again gains nothing."""
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "InMemoryRelation":
            return True
        if node.nodeName() not in ("Project", "Filter") or node.children().size() != 1:
            return False
        nodes.append(node.children().head())
    return False


class held:
    """``with held(df) as cached:`` caches for the block, unless that would only copy a cache."""

    def __init__(self, df: DataFrame):
        self.df = df
        cached = df.storageLevel.useMemory or df.storageLevel.useDisk
        self.owner = not cached and not is_view_of_cache(df)

    def __enter__(self) -> DataFrame:
        return hold(self.df) if self.owner else self.df

    def __exit__(self, *exc) -> None:
        if self.owner:
            self.df.unpersist()
