"""Extremely randomised trees grown until their leaves are pure, in two phases.

First passes over all rows grow every tree level by level (:mod:`pipegrid.operators.trees`), until nodes hold about
``NODE_ROWS`` rows or ``FIRST_LEVELS`` levels are done. Impure nodes at the last level are then dealt out whole, a (tree,
node) group per task, and finished there. A node that still has more than ``LARGE_ROWS`` rows goes through passes of its
own before it is dealt, so that no task gets more. What tasks grow stays a table; scoring meets it by the same key.

Growth moves the rows of impure nodes once per tree; with ``trees.grow_extra_trees`` and a depth nothing is moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, Features
from pipegrid.functions.blocks import as_block, from_block
from pipegrid.operators.trees import Forest, average_importances, grow_levels
from pipegrid.session import cut_lineage

NODE_ROWS = 4_096
FIRST_LEVELS = 8
LARGE_ROWS = 1 << 18

FINISHED, DEALT, DEEPER = 0, 1, 2
SUBTREES = "node string, split_column array<int>, threshold array<double>, lower array<int>, counts array<double>, gains array<double>"


@dataclass(frozen=True)
class Part:
    """What passes have grown of one tree, or of one large node, in heap order."""

    forest: Forest  # of one tree
    counts: np.ndarray  # (nodes, classes) training rows
    state: np.ndarray  # of the leaves

    def walk(self, name: str, parts: dict[str, Part], x: np.ndarray, rows: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray | None]]:
        """(node, rows, class shares) of rows that end here or below; no shares where a task has finished the node."""
        at = self.forest.leaves(x[rows])[:, 0]
        for leaf in np.unique(at):
            mine, node = rows[at == leaf], f"{name}:{leaf}"
            if self.state[leaf] == DEEPER:
                yield from parts[node].walk(node, parts, x, mine)
            else:
                yield node, mine, None if self.state[leaf] == DEALT else self.counts[leaf] / max(self.counts[leaf].sum(), 1)


@dataclass(frozen=True)
class DeepForest:
    n_trees: int
    classes: int
    parts: dict[str, Part]
    subtrees: DataFrame
    importances: np.ndarray = field(compare=False)

    def votes(self, rows: DataFrame, dim: int) -> DataFrame:
        """(row_id, votes): the class shares of a row's leaves, summed over trees."""
        parts, n_trees, classes = self.parts, self.n_trees, self.classes

        def settle(batches):
            for batch in batches:
                x = as_block(batch.column(ARRAY), dim)
                total = np.zeros((len(x), classes))
                for t in range(n_trees):
                    for _, mine, shares in parts[str(t)].walk(str(t), parts, x, np.arange(len(x))):
                        if shares is not None:
                            total[mine] += shares
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), from_block(total)], names=["row_id", "votes"])

        known = rows.select("row_id", ARRAY).mapInArrow(settle, "row_id bigint, votes array<double>")

        def descend(_key: tuple, some: pa.Table, subtree: pa.Table) -> pa.Table:
            if not some.num_rows:
                return pa.table({"row_id": pa.array([], pa.int64()), "votes": from_block(np.zeros((0, classes)))})
            column, threshold, lower, counts = (np.asarray(subtree[c][0].as_py()) for c in ("split_column", "threshold", "lower", "counts"))
            x, at = as_block(some[ARRAY], dim), np.zeros(some.num_rows, dtype=np.int64)
            while (column[at] >= 0).any():
                inner = column[at]
                child = lower[at] + (x[np.arange(len(x)), np.maximum(inner, 0)] > threshold[at])
                at = np.where(inner >= 0, child, at)
            shares = counts.reshape(-1, classes)[at]
            return pa.table({"row_id": some["row_id"], "votes": from_block(shares / shares.sum(axis=1, keepdims=True))})

        open_rows = _dealt(rows.select("row_id", ARRAY), dim, parts, n_trees).groupBy("node")
        below = open_rows.cogroup(self.subtrees.groupBy("node")).applyInArrow(descend, "row_id bigint, votes array<double>")
        sums = F.array(*[F.round(F.sum(F.col("votes")[k]), 9) for k in range(classes)])
        return known.unionByName(below).groupBy("row_id").agg(sums.alias("votes"))

    def predict(self, features: Features) -> DataFrame:
        """Ties between classes go to the lower one."""
        voted = self.votes(features.with_array(), features.dim)
        chosen = voted.select("row_id", (F.array_position("votes", F.array_max("votes")) - 1).cast("int").alias("y_pred"))
        return features.df.select(*features.keys()).join(chosen, "row_id")

    def leaves(self) -> DataFrame:
        """(tree, node, counts): every leaf with its training rows by class. What passes finished is bounded in number."""
        done = []
        for name, part in self.parts.items():
            ends = (part.forest.column[0] < 0) & (part.counts.sum(axis=1) > 0) & (part.state == FINISHED)
            done += [(int(name.split(":")[0]), f"{name}:{k}", part.counts[k].tolist()) for k in np.flatnonzero(ends)]
        spark, classes = self.subtrees.sparkSession, self.classes
        shallow = spark.createDataFrame(done, "tree int, node string, counts array<double>")
        nodes = self.subtrees.select("node", "counts", F.posexplode("split_column").alias("at", "split_column")).filter("split_column < 0")
        deep = nodes.select(
            F.substring_index("node", ":", 1).cast("int").alias("tree"),
            F.concat_ws("/", "node", "at").alias("node"),
            F.slice("counts", F.col("at") * classes + 1, F.lit(classes)).alias("counts"),
        )
        return shallow.unionByName(deep)


def _dealt(rows: DataFrame, dim: int, parts: dict[str, Part], n_trees: int) -> DataFrame:
    """The rows with ``node``, once for every node that they end in and that a task finishes."""

    def run(batches):
        for batch in batches:
            x = as_block(batch.column(ARRAY), dim)
            for t in range(n_trees):
                for node, mine, shares in parts[str(t)].walk(str(t), parts, x, np.arange(len(x))):
                    if shares is None:
                        taken = batch.take(pa.array(mine))
                        yield pa.RecordBatch.from_arrays([pa.array([node] * len(mine)), *taken.columns], names=["node", *taken.schema.names])

    schema = ", ".join(["node string", *(f"`{n}` {t}" for n, t in rows.dtypes)])
    return rows.mapInArrow(run, schema)


def finish(x: np.ndarray, label: np.ndarray, tried: int, rng: np.random.Generator, classes: int):
    """One node grown to purity: columns (-1 at leaves), thresholds, lower children, counts and the gain per column.

    Per node ``tried`` of the columns that vary in it get a threshold drawn between their ends; the best Gini gain wins.
    """
    column, threshold, lower, counts = [-1], [0.0], [-1], [np.zeros(classes)]
    gains = np.zeros(x.shape[1])
    open_nodes = [(0, np.arange(len(x)))]
    member = np.eye(classes)[label]
    while open_nodes:
        node, rows = open_nodes.pop()
        here = counts[node] = member[rows].sum(axis=0)
        if (here > 0).sum() <= 1:
            continue
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if not len(varying):
            continue
        columns = rng.permutation(varying)[:tried]
        cut = low[columns] + rng.random(len(columns)) * (high[columns] - low[columns])
        cut = np.minimum(cut, np.nextafter(high[columns], low[columns]))
        side = part[:, columns] > cut
        right = member[rows].T @ side
        left = here[:, None] - right
        n_left, n_right = left.sum(axis=0), right.sum(axis=0)
        gain = (left**2).sum(axis=0) / n_left + (right**2).sum(axis=0) / n_right - (here**2).sum() / here.sum()
        best = int(gain.argmax())
        gains[columns[best]] += gain[best]
        column[node], threshold[node], lower[node] = int(columns[best]), float(cut[best]), len(column)
        for child in (rows[~side[:, best]], rows[side[:, best]]):
            open_nodes.append((len(column), child))
            column.append(-1), threshold.append(0.0), lower.append(-1), counts.append(np.zeros(classes))
    return column, threshold, lower, np.array(counts), gains


def grow_to_purity(
    train: Features,
    tried: int,
    seed: int = 0,
    n_trees: int = 100,
    classes: int = 2,
    node_rows: int = NODE_ROWS,
    large_rows: int = LARGE_ROWS,
    first_levels: int = FIRST_LEVELS,
) -> DeepForest:
    """A forest whose leaves are pure, or hold rows that agree in all columns."""
    dim = train.dim
    rows = train.with_array().select("row_id", "label", ARRAY)
    parts: dict[str, Part] = {}
    gains = np.zeros((n_trees, dim))

    def passes(name: str, some: Features, trees: int, seed_of: int) -> None:
        n = some.df.count()
        levels = min(first_levels, max(0, math.ceil(math.log2(max(n, 1) / node_rows))))
        forest, counts, gained = grow_levels(some, tried, seed_of, trees, levels, classes)
        for k in range(trees):
            own = name or str(k)
            size, impure = counts[k].sum(axis=1), (counts[k] > 0).sum(axis=1) > 1
            ends = np.arange(len(size)) >= 2**levels - 1  # above the last level, what didn't split can't
            state = np.where(impure & ends, np.where((size > large_rows) & (levels == first_levels), DEEPER, DEALT), FINISHED)
            parts[own] = Part(Forest(forest.column[k : k + 1], forest.threshold[k : k + 1]), counts[k], state)
            gains[int(own.split(":")[0])] += gained[k]
            for node in np.flatnonzero(state == DEEPER):
                below = f"{own}:{node}"
                passes(below, _inside(some, parts, own, int(node)), 1, seed_of * 1_000_003 + int(node) + 1)

    passes("", train, n_trees, seed)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node = key[0].as_py()
        rng = np.random.default_rng([seed, 19, *(int(v) for v in node.split(":"))])
        column, threshold, lower, counts, gained = finish(as_block(table[ARRAY], dim), table["label"].to_numpy().astype(np.int64), tried, rng, classes)
        one = {"split_column": column, "threshold": threshold, "lower": lower, "counts": counts.reshape(-1).tolist(), "gains": gained.tolist()}
        kinds = {"split_column": pa.int32(), "threshold": pa.float64(), "lower": pa.int32(), "counts": pa.float64(), "gains": pa.float64()}
        return pa.table({"node": pa.array([node]), **{c: pa.array([v], pa.list_(kinds[c])) for c, v in one.items()}})

    subtrees = cut_lineage(_dealt(rows, dim, parts, n_trees).groupBy("node").applyInArrow(run, SUBTREES))
    summed = subtrees.select(F.substring_index("node", ":", 1).cast("int").alias("tree"), F.posexplode("gains").alias("at", "gain"))
    for r in summed.groupBy("tree", "at").agg(F.sum("gain").alias("gain")).collect():  # one number per tree and column
        gains[r.tree, r["at"]] += r.gain
    return DeepForest(n_trees, classes, parts, subtrees, average_importances(gains))


def _inside(some: Features, parts: dict[str, Part], name: str, node: int) -> Features:
    """The rows that end in a node of the part just grown from ``some``."""
    forest, dim = parts[name].forest, some.dim

    def run(batches):
        for batch in batches:
            at = forest.leaves(as_block(batch.column(ARRAY), dim))[:, 0]
            yield batch.filter(pa.array(at == node))

    rows = some.with_array()
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return Features(cut_lineage(rows.mapInArrow(run, schema)), (), dim)
