"""Classification trees by best Gini splits between 255 quantile bins, grown until their leaves are pure.

A bootstrap weight is a function of seed, tree and row id, so no sample is stored. Nodes of more than ``node_rows`` rows are
split by passes over all rows, whose histograms (tree, node, column, bin, class) come in portions of ``HISTOGRAM`` numbers;
a smaller impure node is dealt to a task with its rows' bins, a byte per column, and finished there: nodes of a level share
sorted runs, so its cost follows its rows and not the bins of its nodes. What tasks grow stays a table, as in
:mod:`pipegrid.operators.deep_trees`, and scoring meets it by node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, Features
from pipegrid.functions.blocks import as_block, from_block, partial_sums
from pipegrid.session import cut_lineage, held

CUTS = 254  #: between 255 bins
NODE_ROWS = 1 << 17  #: rows of a node that a task finishes
TREE_ROWS = 1 << 14  #: the same if there is one tree only
HISTOGRAM = 1 << 20  #: numbers that a pass sums
TINY = 1e-9  #: a gain up to this is none
SUBTREES = "node string, split_column array<int>, cut array<int>, lower array<int>, shares array<double>"


def bin_cuts(train: Features) -> list[np.ndarray]:
    """Increasing cuts of every column, at the quantiles of its values."""
    names = [f"q{j}" for j in range(train.dim)]
    columns = train.df.select(*[e.alias(n) for e, n in zip(train.elements(), names)])
    found = columns.approxQuantile(names, [(i + 1) / (CUTS + 1) for i in range(CUTS)], 1 / (8 * CUTS))
    return [np.unique(v) for v in found]


def bins_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of every value: as many cuts as lie below it."""
    return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _mixed(values: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number."""
    values = values + np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


_POISSON = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880]))


def sample_weights(row_ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample."""
    start = _mixed(np.array([seed], np.int64).view(np.uint64) * np.uint64(1_000_003) + np.uint64(tree))
    drawn = _mixed(_mixed(row_ids.astype(np.int64).view(np.uint64) ^ start))
    return np.searchsorted(_POISSON, (drawn >> np.uint64(11)).astype(float) / (1 << 53), side="right")


def _gains(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Gini gains (times rows) of left parts of wholes; the last axis is the class."""
    right, sizes = whole - left, [np.maximum(v.sum(-1), 1e-300) for v in (left, whole)]
    with np.errstate(invalid="ignore"):
        rest = np.maximum(right.sum(-1), 1e-300)
        gain = (left**2).sum(-1) / sizes[0] + (right**2).sum(-1) / rest - (whole**2).sum(-1) / sizes[1]
    return np.where((left.sum(-1) > 0) & (right.sum(-1) > 0), gain, -1.0)


def tried_columns(rng: np.random.Generator, nodes: int, dim: int, tried: int) -> np.ndarray:
    """(nodes, tried) columns in random order."""
    if tried >= dim:
        return np.tile(np.arange(dim), (nodes, 1))
    return np.argsort(rng.random((nodes, dim)), axis=1)[:, :tried]


def finish(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, tried: int, rng: np.random.Generator, classes: int):
    """One node grown level by level: columns (-1 at leaves), cuts, lower children and class shares.

    Where none of the tried columns has a gain, all of them are tried, so that leaves are pure or alike in all columns.
    """
    dim = bins.shape[1]
    member = np.eye(classes)[label] * weight[:, None]
    column, cut, lower = [np.array([-1])], [np.array([0])], [np.array([-1])]
    counts = [member.sum(axis=0)[None, :]]
    total, first = 1, 0  # nodes so far, and the first one of this level
    rows, node = np.arange(len(bins)), np.zeros(len(bins), np.int64)  # of the level
    while len(rows):
        here = counts[-1]
        impure = (here > 0).sum(axis=1) > 1
        keep = impure[node]
        rows, node = rows[keep], node[keep]
        best = np.full(len(here), TINY)
        choice, at = np.full(len(here), -1), np.zeros(len(here), np.int64)

        def look(mine: np.ndarray, of: np.ndarray, columns: np.ndarray) -> None:
            for c in range(columns.shape[1]):
                own = bins[mine, columns[of, c]]
                order = np.argsort(of << 8 | own, kind="stable")
                sorted_of, sorted_bin = of[order], own[order]
                sums = np.cumsum(member[mine[order]], axis=0)
                heads = np.flatnonzero(np.append(True, sorted_of[1:] != sorted_of[:-1]))
                before = np.concatenate([np.zeros((1, classes)), sums])[heads]
                owner = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
                ends = np.flatnonzero((sorted_of[1:] == sorted_of[:-1]) & (sorted_bin[1:] != sorted_bin[:-1]))  # of a bin inside a node
                if not len(ends):
                    continue
                gain = _gains(sums[ends] - before[owner[ends]], here[sorted_of[ends]])
                runs = np.flatnonzero(np.append(True, sorted_of[ends][1:] != sorted_of[ends][:-1]))
                most = np.maximum.reduceat(gain, runs)
                top = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(runs, len(ends)))))
                top = top[np.searchsorted(sorted_of[ends[top]], sorted_of[ends[runs]])]
                nodes = sorted_of[ends[runs]]
                better = most > best[nodes]
                nodes, top = nodes[better], top[better]
                best[nodes], choice[nodes], at[nodes] = gain[top], columns[nodes, c], sorted_bin[ends[top]]

        if len(rows):
            look(rows, node, tried_columns(rng, len(here), dim, tried))
            missed = (choice < 0)[node]
            if tried < dim and missed.any():
                look(rows[missed], node[missed], np.tile(np.arange(dim), (len(here), 1)))
        split = choice >= 0
        born = np.cumsum(split) - split
        column[-1], cut[-1] = choice, at
        lower[-1] = np.where(split, total + 2 * born, -1)
        keep = split[node]
        rows, node = rows[keep], node[keep]
        node = 2 * born[node] + (bins[rows, choice[node]] > at[node])
        grown = 2 * int(split.sum())
        first, total = total, total + grown
        if grown:
            column.append(np.full(grown, -1)), cut.append(np.zeros(grown, np.int64)), lower.append(np.full(grown, -1))
            counts.append(np.stack([np.bincount(node, member[rows, k], grown) for k in range(classes)], axis=1))
    counts = np.concatenate(counts)
    return np.concatenate(column), np.concatenate(cut), np.concatenate(lower), counts / counts.sum(axis=1, keepdims=True)


@dataclass
class Top:
    """What passes have grown of one tree. State: -1 is inner, 0 a leaf, 1 dealt to a task."""

    column: list[int]
    cut: list[int]
    lower: list[int]
    shares: list[np.ndarray]
    state: list[int]

    def ends(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        column, cut, lower = map(np.asarray, (self.column, self.cut, self.lower))
        while (inner := column[at] >= 0).any():
            child = lower[at] + (bins[np.arange(len(bins)), np.maximum(column[at], 0)] > cut[at])
            at = np.where(inner, child, at)
        return at


@dataclass(frozen=True)
class BinnedForest:
    cuts: list[np.ndarray]
    classes: int
    tops: list[Top]
    subtrees: DataFrame

    def votes(self, rows: DataFrame) -> DataFrame:
        """(row_id, votes): class shares of a row's leaves, summed over trees."""
        cuts, classes, tops = self.cuts, self.classes, self.tops

        def descend(_key: tuple, some: pa.Table, subtree: pa.Table) -> pa.Table:
            if not some.num_rows or not subtree.num_rows:
                return pa.table({"row_id": pa.array([], pa.int64()), "votes": from_block(np.zeros((0, classes)))})
            column, cut, lower, shares = (np.asarray(subtree[c][0].as_py()) for c in ("split_column", "cut", "lower", "shares"))
            bins = _block_of(some["bins"], len(cuts))
            at = Top(column, cut, lower, [], []).ends(bins)
            return pa.table({"row_id": some["row_id"], "votes": from_block(shares.reshape(-1, classes)[at])})

        def settle(batches):
            for batch in batches:
                bins = bins_of(as_block(batch.column(ARRAY), len(cuts)), cuts)
                total = np.zeros((len(bins), classes))
                for top in tops:
                    at, state = top.ends(bins), np.asarray(top.state)
                    total += np.where((state[at] == 0)[:, None], np.asarray(top.shares)[at], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), from_block(total)], names=["row_id", "votes"])

        below = _dealt(rows.select("row_id", ARRAY), cuts, tops, None).groupBy("node").cogroup(self.subtrees.groupBy("node"))
        votes = below.applyInArrow(descend, "row_id bigint, votes array<double>")
        if any(0 in top.state for top in tops):
            votes = votes.unionByName(rows.select("row_id", ARRAY).mapInArrow(settle, "row_id bigint, votes array<double>"))
        sums = F.array(*[F.round(F.sum(F.col("votes")[k]), 9) for k in range(classes)])
        return votes.groupBy("row_id").agg(sums.alias("votes"))

    def predict(self, features: Features) -> DataFrame:
        """Ties between classes go to the lower one."""
        voted = self.votes(features.with_array())
        chosen = voted.select("row_id", (F.array_position("votes", F.array_max("votes")) - 1).cast("int").alias("y_pred"))
        return features.df.select(*features.keys()).join(chosen, "row_id")


def _block_of(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, dim)


def _dealt(rows: DataFrame, cuts: list[np.ndarray], tops: list[Top], seed: int | None) -> DataFrame:
    """(node, row_id, bins[, label, weight]): rows once for every dealt node that they end in; with a seed, of the samples."""
    fields = [("node", "string"), ("row_id", "bigint"), ("bins", "binary"), *([("label", "int"), ("weight", "int")] if seed is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = bins_of(as_block(batch.column(ARRAY), len(cuts)), cuts)
            packed = pa.array([r.tobytes() for r in bins], pa.binary())
            ids = batch.column("row_id").to_numpy(zero_copy_only=False)
            for t, top in enumerate(tops):
                weight = np.ones(len(ids), np.int32) if seed is None or len(tops) == 1 else sample_weights(ids, t, seed).astype(np.int32)
                at = top.ends(bins)
                mine = np.flatnonzero((np.asarray(top.state)[at] == 1) & (weight > 0))
                if not len(mine):
                    continue
                take = pa.array(mine)
                out = [pa.array([f"{t}:{k}" for k in at[mine].tolist()]), batch.column("row_id").take(take), packed.take(take)]
                if seed is not None:
                    out += [batch.column("label").take(take).cast(pa.int32()), pa.array(weight[mine])]
                yield pa.RecordBatch.from_arrays(out, names=[n for n, _ in fields])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))


def _passes(rows: DataFrame, cuts: list[np.ndarray], tops: list[Top], tried: int, seed: int, classes: int, node_rows: int) -> None:
    """Split the nodes of more than ``node_rows`` rows, a level of all trees at a time."""
    dim = len(cuts)
    open_nodes = [(t, 0) for t in range(len(tops))]
    rng = np.random.default_rng([seed, 23])
    portion = max(1, HISTOGRAM // (tried * 256 * classes))
    while open_nodes:
        later = []
        for first in range(0, len(open_nodes), portion):
            some = open_nodes[first : first + portion]
            columns = tried_columns(rng, len(some), dim, tried)
            shape = (len(some), tried, 256, classes)

            def partial(data):
                bins, out = bins_of(data[ARRAY], cuts).astype(np.int64), np.zeros((len(some), tried, 256 * classes))
                label = data["label"].astype(np.int64)
                for t in sorted({t for t, _ in some}):
                    slots = {k: s for s, (u, k) in enumerate(some) if u == t}
                    weight = np.ones(len(bins)) if len(tops) == 1 else sample_weights(data["row_id"], t, seed)
                    at = tops[t].ends(bins)
                    for k, s in slots.items():
                        mine = np.flatnonzero((at == k) & (weight > 0))
                        for c in range(tried):
                            out[s, c] += np.bincount(bins[mine, columns[s, c]] * classes + label[mine], weight[mine], 256 * classes)
                return out.reshape(-1)

            found = partial_sums(rows, {ARRAY: dim}, ["label", "row_id"], partial, int(np.prod(shape))).reshape(shape)
            for (t, k), hist, tries in zip(some, found, columns):
                whole = hist[0].sum(axis=0)
                left = np.cumsum(hist, axis=1)
                gain = _gains(left, whole)
                c, b = np.unravel_index(gain.argmax(), gain.shape)
                top = tops[t]
                if gain[c, b] <= TINY:
                    top.state[k], top.shares[k] = (1 if (whole > 0).sum() > 1 else 0), whole / max(whole.sum(), 1)
                    continue
                top.column[k], top.cut[k], top.lower[k], top.state[k] = int(tries[c]), int(b), len(top.column), -1
                for counts in (left[c, b], whole - left[c, b]):
                    impure = (counts > 0).sum() > 1
                    if impure and counts.sum() > node_rows:
                        later.append((t, len(top.column)))
                    top.column.append(-1), top.cut.append(0), top.lower.append(-1)
                    top.shares.append(counts / counts.sum()), top.state.append(1 if impure else 0)
        open_nodes = later


def fit_binned_forest(train: Features, seed: int = 0, n_trees: int = 100, tried: int | None = None, node_rows: int = NODE_ROWS) -> BinnedForest:
    """Trees on bootstrap samples (a single tree: on all rows), of a root of the columns per node unless ``tried`` is given."""
    dim = train.dim
    tried = tried or max(1, int(dim**0.5))
    with held(train.with_array().select("row_id", "label", ARRAY)) as rows:
        n, classes = rows.agg(F.count("*"), F.max("label")).first()
        classes = int(classes or 0) + 1
        cuts = bin_cuts(train)
        tops = [Top([-1], [0], [-1], [np.full(classes, 1 / classes)], [1]) for _ in range(n_trees)]
        if n > node_rows:
            _passes(rows, cuts, tops, tried, seed, classes, node_rows)

        def run(key: tuple, table: pa.Table) -> pa.Table:
            node = key[0].as_py()
            table = table.sort_by("row_id")
            rng = np.random.default_rng([seed, 29, *(int(v) for v in node.split(":"))])
            label, weight = (table[c].to_numpy().astype(np.int64) for c in ("label", "weight"))
            made = finish(_block_of(table["bins"], dim), label, weight, tried, rng, classes)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
            return pa.table({"node": pa.array([node]), **{c: pa.array([v.reshape(-1)], pa.list_(k)) for c, v, k in zip(("split_column", "cut", "lower", "shares"), made, kinds)}})

        subtrees = cut_lineage(_dealt(rows, cuts, tops, seed).groupBy("node").applyInArrow(run, SUBTREES), free_shuffles=True)
    return BinnedForest(cuts, classes, tops, subtrees)
