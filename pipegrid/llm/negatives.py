"""Hard negatives by exact inner-product search with coordinate pruning inside length buckets.

Every anchor looks for the best rows of its own label (its positives), and for each positive for the best rows of other
labels whose score lies in a band around the positive's. Rows are sorted by length and cut into blocks of rows of
similar length, each with a sorted list per coordinate. For an anchor ``q`` and a least score ``t`` a block whose greatest
length ``l`` can't reach it (``|q| l < t``) is passed over. In any other block the rows' directions must have an inner
product of ``t / (|q| l)`` at least with the anchor's direction, which confines every coordinate of a row's direction to
an interval. The anchor's largest coordinates (its focus) look their intervals up in the sorted lists, only rows in all
of them are scored, and every score is an exact integer.

Spark deals pairs of a row block and an anchor group to tasks, both of bounded size, so no label, length or id makes a
task larger; pairs that lengths rule out are not dealt. The least score of an anchor comes from a first look at a few
blocks, which costs anchors times a constant: the k-th best of some rows is never above the k-th best of all. Tasks return
the best few rows per anchor and list, and a window per list merges these.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows equal in id, label and vector
count once; rows that share an id but differ are rows of their own, never each other's positives or negatives, and tie in
the order of a hash. Vectors shorter than others count as filled up with zeros; scores are exact up to 2**53. Fewer rows
than asked for give fewer results, an anchor without positives none, and an empty table an empty result. Only id, vector
and label are read, so other columns can have any names. Texts don't occur here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipegrid.session import cut_lineage

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  #: a negative's score in per cent of its positive's
ROWS = 8192  #: rows in a block, about
ANCHORS = 4096  #: anchors in a group, about
FOCUS = 5  #: coordinates of an anchor that prune
LOOK = 1  #: row blocks that give an anchor group its first bounds
STEPS = 64  #: ranges of lengths between a length and its double
ALL = 1 << 62  #: beyond any score

FOUND = "key long, list int, score long, vec_id long, row long"


def usable(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The rows that take part: components floored to 256ths, every ``every``-th id with the next label; ``row`` is a key."""
    shifted = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taken = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    floored = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    made = taken.select(F.col("vec_id").cast("long").alias("vec_id"), shifted.cast("int").alias("label"), floored.alias("v"))
    return made.withColumn("row", F.xxhash64("vec_id", "label", "v")).dropDuplicates(["row"]).select("vec_id", "label", "v", "row")


def _length(v: str = "v"):
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def in_blocks(rows: DataFrame, size: int = ROWS) -> tuple[DataFrame, int]:
    """``rows`` with ``block``, rows of like length together, about ``size`` of them at most; and the number of blocks.

    Lengths are counted in geometric ranges. A full range is parted by the rows' hash, small neighbours share a block.
    The counts, a row for each of at most ``STEPS`` ranges per doubling, are what comes to the driver.
    """
    at = F.coalesce(F.floor(F.log2(F.nullif(_length(), F.lit(0.0))) * STEPS).cast("int"), F.lit(-(1 << 30)))
    placed = rows.withColumn("place", at)
    block, room, plan = -1, 0, []
    for place, n in sorted(((r.place, r["count"]) for r in placed.groupBy("place").count().collect()), reverse=True):
        parts = -(-n * 10 // (size * 9)) if n > size // 2 else 1
        if parts > 1 or room < n:
            block, room = block + 1, size
        plan.append((place, block, parts))
        block, room = (block + parts - 1, 0) if parts > 1 else (block, room - n)
    ranges = rows.sparkSession.createDataFrame(plan, "place int, first long, parts long")
    spread = F.col("first") + F.pmod(F.xxhash64(F.lit("block"), "row"), F.col("parts"))
    return placed.join(F.broadcast(ranges), "place").select("vec_id", "label", "v", "row", spread.alias("block")), block + 1


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    if {len(v) for v in vectors} == {width}:
        return np.stack(vectors.to_numpy()).astype(np.float64)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Block:
    """Rows of like length with a sorted list per coordinate of their directions."""

    def __init__(self, vectors: np.ndarray, focus: int = FOCUS):
        self.vectors, self.focus = vectors, focus
        lengths = np.sqrt((vectors**2).sum(1))
        self.longest = float(lengths.max(initial=0.0))
        self.directions = vectors / np.where(lengths > 0, lengths, 1)[:, None]
        self.order = np.argsort(self.directions, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.directions, self.order, axis=0)

    def ranges(self, anchor: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Focus coordinates, and the least and greatest value there of a direction that may reach ``least`` (above 0).

        A direction at inner product ``s`` with the anchor's has ``s d`` plus or minus ``sqrt((1 - s^2) (1 - d^2))`` where
        that one has ``d``; over all ``s`` from the angle on, the ends are at the angle itself unless ``d`` is beyond it.
        """
        length = float(np.sqrt(anchor @ anchor))
        angle = least / (length * self.longest)
        direction = anchor / length
        focus = np.argsort(-np.abs(direction), kind="stable")[: self.focus]
        d = direction[focus]
        half = np.sqrt(max(0.0, 1 - angle * angle)) * np.sqrt(np.maximum(0.0, 1 - d * d))
        low = np.where(d <= -angle, -1.0, angle * d - half)
        high = np.where(d >= angle, 1.0, angle * d + half)
        return focus, low - 1e-9, high + 1e-9

    def candidates(self, anchor: np.ndarray, least: float) -> np.ndarray:
        """Places of all rows that may reach the score ``least``: those in the ranges of all focus coordinates."""
        everything = np.arange(len(self.vectors))
        if least <= 0:
            return everything
        if np.sqrt(anchor @ anchor) * self.longest < least * (1 - 1e-9):
            return everything[:0]
        focus, low, high = self.ranges(anchor, least)
        lists = [(np.searchsorted(self.lists[:, f], a, "left"), np.searchsorted(self.lists[:, f], b, "right"), f) for f, a, b in zip(focus, low, high)]
        start, stop, f = min(lists, key=lambda x: x[1] - x[0])
        found = self.order[start:stop, f]  # the shortest list, and of it what the other ranges hold too
        near = self.directions[found[:, None], focus]
        return found[((near >= low) & (near <= high)).all(1)]


def _best(score: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: highest score, then least id, then least key."""
    some = np.arange(len(score))
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return some[np.lexsort((keys[some], ids[some], -score[some]))[:k]]


def _search(k: int, own: bool):
    """A task's function: a block of rows against a group of anchors, the ``k`` best rows here of every anchor's lists."""

    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"key": [], "list": [], "score": [], "vec_id": [], "row": []}
        if len(rows) and len(anchors):
            width = max(rows.v.map(len).max(), anchors.v.map(len).max())
            block = Block(_matrix(rows.v, width))
            ids, labels, keys = rows.vec_id.to_numpy(), rows.label.to_numpy(), rows.row.to_numpy()
            for anchor, vec_id, label, key, lists in zip(_matrix(anchors.v, width), anchors.vec_id, anchors.label, anchors.key, anchors.lists):
                here = block.candidates(anchor, float(min(x["least"] for x in lists)))
                here = here[((labels[here] == label) == own) & (ids[here] != vec_id)]
                score = (block.vectors[here] @ anchor).astype(np.int64)
                for x in lists:
                    fits = np.flatnonzero((score >= x["least"]) & (score <= x["most"]))
                    best = fits[_best(score[fits], ids[here[fits]], keys[here[fits]], k)]
                    for name, values in (("key", [key] * len(best)), ("list", [x["list"]] * len(best)), ("score", score[best]), ("vec_id", ids[here[best]]), ("row", keys[here[best]])):
                        out[name].extend(values)
        return pd.DataFrame(out)

    return run


def _meet(rows: DataFrame, anchors: DataFrame, pairs: DataFrame, k: int, own: bool) -> DataFrame:
    """The ``k`` best rows of every anchor's lists, over the (block, group) pairs. With ``rank``, from 1."""
    tiles, facing = rows.join(pairs, "block"), anchors.join(pairs, "group")
    # new names for columns that both sides have from one table
    tiles, facing = (side.toDF(*side.columns).groupBy("block", "group") for side in (tiles, facing))
    found = tiles.cogroup(facing).applyInPandas(_search(k, own), FOUND)
    order = W.partitionBy("key", "list").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_rows(rows: DataFrame, blocks: int, anchors: DataFrame, groups: int, k: int, own: bool) -> DataFrame:
    """(key, list, score, vec_id, row, rank): the ``k`` best rows of every list, exactly.

    ``rows`` has blocks, ``anchors`` has key, vec_id, label, v, group and lists, an array of (list, least, most): the rows
    that count have the anchor's label (``own``) or another one, and a score from least to most.
    """
    spark = rows.sparkSession
    few = spark.range(groups).select(F.col("id").alias("group"), F.explode(F.array_distinct(F.array(*(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(max(blocks, 1))) for i in range(LOOK))))).alias("block"))
    first = _meet(rows, anchors, few, k, own).filter(F.col("rank") == k)
    kth = first.groupBy("key").agg(F.map_from_arrays(F.collect_list("list"), F.collect_list("score")).alias("kth"))
    raised = F.transform(
        "lists",
        lambda x: F.struct(x["list"].alias("list"), F.greatest(x["least"], F.coalesce(F.try_element_at("kth", x["list"]), x["least"])).alias("least"), x["most"].alias("most")),
    )
    bounded = cut_lineage(anchors.join(kth, "key", "left").withColumn("lists", raised).drop("kth"))
    longest = rows.groupBy("block").agg(F.max(_length()).alias("longest"))
    reach = bounded.groupBy("group").agg(F.max(_length()).alias("reach"), F.min(F.array_min(F.transform("lists", lambda x: x["least"]))).alias("least"))
    every = spark.range(groups).select(F.col("id").alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    able = every.join(longest, "block").join(reach, "group").filter((F.col("least") <= 0) | (F.col("longest") * F.col("reach") >= F.col("least") * (1 - 1e-9)))
    return _meet(rows, bounded, able.select("block", "group"), k, own)


def mine(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Hard negatives of the anchors, the rows whose id ``every`` divides.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of an anchor's ``positives`` best
    rows of its label the ``negatives`` best rows of other labels that score ``LOW`` to ``HIGH`` per cent of it.
    """
    rows, blocks = in_blocks(cut_lineage(usable(embeddings)))
    rows = cut_lineage(rows)
    chosen = rows.filter(F.col("vec_id") % every == 0)
    groups = -(-chosen.count() // ANCHORS)
    if not groups:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    one = F.array(F.struct(F.lit(0).alias("list"), F.lit(-ALL).alias("least"), F.lit(ALL).alias("most")))
    anchors = chosen.select(
        F.col("row").alias("key"), "vec_id", "label", "v", F.pmod(F.xxhash64(F.lit("group"), "row"), F.lit(groups)).alias("group"), one.alias("lists")
    )
    near = cut_lineage(top_rows(rows, blocks, anchors, groups, positives, True))
    band = F.struct(F.col("rank").alias("list"), F.expr(f"(score * {LOW} + 99) div 100").alias("least"), F.expr(f"score * {HIGH} div 100").alias("most"))
    bands = near.filter("score >= 0").groupBy("key").agg(F.array_sort(F.collect_list(band)).alias("lists"))
    far = top_rows(rows, blocks, anchors.drop("lists").join(bands, "key"), groups, negatives, False)
    named = near.select("key", F.col("rank").alias("list"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    who = anchors.select("key", F.col("vec_id").alias("anchor_id"))
    return (
        far.join(named, ["key", "list"])
        .join(who, "key")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
