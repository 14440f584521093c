"""Random trees grown level by level: one or two passes per level for all trees together.

A pass sums small tables per (tree, node, candidate column), so the shuffle and the
driver only see model-sized arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, Features, from_array
from pipegrid.functions.blocks import block_map, block_score, partial_sums
from pipegrid.session import held


@dataclass(frozen=True)
class Forest:
    """Binary trees in heap order: children of node i are 2i+1 and 2i+2; column -1 is a leaf."""

    column: np.ndarray  # (trees, nodes)
    threshold: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Heap position of the leaf per row and tree."""
        n_trees, n_nodes = self.column.shape
        at = np.zeros((len(x), n_trees), dtype=np.int64)
        trees = np.arange(n_trees)[None, :]
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(n_nodes + 1))):
            column = self.column[trees, at]
            value = x[rows, np.maximum(column, 0)]
            child = 2 * at + 1 + (value > self.threshold[trees, at])
            at = np.where(column >= 0, child, at)
        return at


def _column_order(seed: int, level: int, n_trees: int, width: int, dim: int) -> np.ndarray:
    """The order in which columns are tried per (tree, node), a function of the seed only."""
    return np.argsort(np.random.default_rng([seed, level, 7]).random((n_trees, width, dim)), axis=2)


def _node_ranges(rows: DataFrame, dim: int, forest: Forest, asked: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """(slots, columns, 2): minimum and negated maximum of each slot's columns.

    ``asked`` (trees, nodes of the level) gives a node's slot, -1 for nodes nobody asks about.
    """
    n_trees, width = asked.shape
    base = width - 1

    def partial(data):
        x = data[ARRAY]
        at = forest.leaves(x) - base
        out = np.full((*columns.shape, 2), np.inf)
        for t in range(n_trees):
            slot = np.where(at[:, t] >= 0, asked[t][at[:, t]], -1)
            mine = np.where(slot >= 0)[0]
            values = x[mine[:, None], columns[slot[mine]]]
            np.minimum.at(out[..., 0], slot[mine], values)
            np.minimum.at(out[..., 1], slot[mine], -values)
        return out.reshape(-1)

    return partial_sums(rows, {ARRAY: dim}, [], partial, columns.size * 2, "min").reshape(*columns.shape, 2)


FIRST_LOOK = 8  # columns of a node whose ranges the first pass takes


def _varying_columns(rows: DataFrame, dim: int, forest: Forest, order: np.ndarray, wanted: int):
    """The first ``wanted`` columns of each node's order that vary in it, with their ranges.

    (trees, nodes, wanted) columns, minima and maxima; a node with fewer such columns ends in constant ones. Most
    nodes are settled by one pass; a second one looks at all other columns of the rest.
    """
    n_trees, width, _ = order.shape
    count = min(dim, max(wanted, FIRST_LOOK))
    everyone = np.arange(n_trees * width).reshape(n_trees, width)
    flat = order.reshape(-1, dim)
    found = np.zeros((len(flat), dim, 2))
    found[:, :count] = _node_ranges(rows, dim, forest, everyone, flat[:, :count])
    low, high = found[..., 0], -found[..., 1]
    short = np.isfinite(low[:, 0]) & ((high > low)[:, :count].sum(axis=1) < wanted)
    if count < dim and short.any():
        asked = np.full(len(flat), -1)
        asked[short] = np.arange(int(short.sum()))
        rest = _node_ranges(rows, dim, forest, asked.reshape(n_trees, width), flat[short, count:])
        low[short, count:], high[short, count:] = rest[..., 0], -rest[..., 1]
    with np.errstate(invalid="ignore"):
        first = np.argsort(~(high > low), axis=1, kind="stable")[:, :wanted]
    take = lambda a: np.take_along_axis(a, first, axis=1).reshape(n_trees, width, -1)
    return take(flat), take(low), take(high)


def grow_random_trees(train: Features, seed: int, n_trees: int = 10, depth: int = 5) -> Forest:
    """Totally random trees: a random column that varies in the node, a uniform threshold."""
    dim = train.dim
    n_nodes = 2 ** (depth + 1) - 1
    column = np.full((n_trees, n_nodes), -1, dtype=np.int64)
    threshold = np.zeros((n_trees, n_nodes))
    with held(train.with_array()) as rows:
        for level in range(depth):
            width = 2**level
            order = _column_order(seed, level, n_trees, width, dim)
            forest = Forest(column.copy(), threshold.copy())
            tried, low, high = (a[..., 0] for a in _varying_columns(rows, dim, forest, order, 1))
            share = np.random.default_rng([seed, level, 11]).random((n_trees, width))
            t, node = np.where(high > low)
            column[t, width - 1 + node] = tried[t, node]
            threshold[t, width - 1 + node] = low[t, node] + share[t, node] * (high[t, node] - low[t, node])
            if (column[:, width - 1 : 2 * width - 1] < 0).all():
                break
    return Forest(column, threshold)


@dataclass(frozen=True)
class LeafIndicator:
    """One column per leaf that holds training rows."""

    forest: Forest
    slots: np.ndarray  # (trees, nodes) -> output column, -1 for leaves without training rows
    width: int

    def apply(self, features: Features) -> Features:
        forest, slots, width = self.forest, self.slots, self.width

        def indicate(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(x), width))
            at = forest.leaves(x)
            for t in range(at.shape[1]):
                slot = slots[t, at[:, t]]
                known = slot >= 0
                out[np.where(known)[0], slot[known]] = 1.0
            return out

        made = block_map(indicate, features.array(), features.dim)
        return from_array(features.df.select(*features.keys(), made.alias(ARRAY)), width)


def _leaf_sums(rows: DataFrame, dim: int, forest: Forest, classes: int) -> np.ndarray:
    """Training rows per (tree, node, class)."""
    n_trees, n_nodes = forest.column.shape

    def partial(data):
        at = forest.leaves(data[ARRAY])
        label = data["label"].astype(np.int64) if classes > 1 else np.zeros(len(at), dtype=np.int64)
        out = np.zeros((n_trees, n_nodes * classes))
        for t in range(n_trees):
            out[t] = np.bincount(at[:, t] * classes + label, minlength=n_nodes * classes)
        return out.reshape(-1)

    total = partial_sums(rows, {ARRAY: dim}, ["label"], partial, n_trees * n_nodes * classes)
    return total.reshape(n_trees, n_nodes, classes)


def fit_random_trees_embedding(train: Features, seed: int = 0, n_trees: int = 10, depth: int = 5) -> LeafIndicator:
    forest = grow_random_trees(train, seed, n_trees, depth)
    used = _leaf_sums(train.with_array(), train.dim, forest, 1)[..., 0] > 0
    slots = np.full(used.shape, -1, dtype=np.int64)
    slots[used] = np.arange(int(used.sum()))
    return LeafIndicator(forest, slots, int(used.sum()))


@dataclass(frozen=True)
class ExtraTrees:
    forest: Forest
    shares: np.ndarray  # (trees, nodes, classes) class shares of the leaves
    importances: np.ndarray

    def predict(self, features: Features) -> DataFrame:
        forest, shares = self.forest, self.shares

        def choose(x: np.ndarray) -> np.ndarray:
            at = forest.leaves(x)
            total = np.zeros((len(x), shares.shape[2]))
            for t in range(at.shape[1]):
                total += shares[t, at[:, t]]
            return total.argmax(axis=1).astype(float)

        chosen = block_score(choose, features.array(), features.dim).cast("int")
        return features.df.select(*features.keys(), chosen.alias("y_pred"))


def grow_levels(
    train: Features, tried_columns: int, seed: int, n_trees: int, depth: int, classes: int
) -> tuple[Forest, np.ndarray, np.ndarray]:
    """``depth`` levels of extremely randomised trees: per node the best Gini gain among random thresholds.

    The forest, training rows per (tree, node, class) at its leaves, and gains per (tree, column).
    """
    dim = train.dim
    n_nodes = 2 ** (depth + 1) - 1
    column = np.full((n_trees, n_nodes), -1, dtype=np.int64)
    threshold = np.zeros((n_trees, n_nodes))
    gains = np.zeros((n_trees, dim))
    with held(train.with_array()) as rows:
        for level in range(depth):
            width = 2**level
            order = _column_order(seed, level, n_trees, width, dim)
            forest = Forest(column.copy(), threshold.copy())
            tried, low, high = _varying_columns(rows, dim, forest, order, min(dim, tried_columns))
            share = np.random.default_rng([seed, level, 13]).random(low.shape)
            varies = high > low
            with np.errstate(invalid="ignore"):
                cut = np.where(varies, low + share * (high - low), 0.0)
            if not varies.any():
                break
            sides = _side_counts(rows, dim, forest, tried, cut, classes)
            left, right = sides[..., 0, :], sides[..., 1, :]
            n_left, n_right = left.sum(-1), right.sum(-1)
            n = n_left + n_right
            both = left + right
            with np.errstate(divide="ignore", invalid="ignore"):
                before = n - (both**2).sum(-1) / n
                after = (n_left - (left**2).sum(-1) / n_left) + (n_right - (right**2).sum(-1) / n_right)
                gain = np.where(varies & (n_left > 0) & (n_right > 0), before - after, -1.0)
                impure = (before > 1e-12).any(axis=2)
            best = gain.argmax(axis=2)
            t, node = np.where(impure & (gain.max(axis=2) >= 0))
            c = best[t, node]
            column[t, width - 1 + node] = tried[t, node, c]
            threshold[t, width - 1 + node] = cut[t, node, c]
            np.add.at(gains, (t, tried[t, node, c]), gain[t, node, c])
            if len(t) == 0:
                break
        forest = Forest(column, threshold)
        counts = _leaf_sums(rows, dim, forest, classes)
    return forest, counts, gains


def average_importances(gains: np.ndarray) -> np.ndarray:
    """Shares of the gain per tree, averaged over trees."""
    per_tree = gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)
    importances = per_tree.mean(axis=0)
    return importances / max(importances.sum(), 1e-300)


def grow_extra_trees(
    train: Features, tried_columns: int, seed: int = 0, n_trees: int = 100, depth: int = 8, classes: int = 2
) -> ExtraTrees:
    """Extremely randomised trees of bounded depth: a model that stays small on any amount of data."""
    forest, counts, gains = grow_levels(train, tried_columns, seed, n_trees, depth, classes)
    total = counts.sum(axis=2, keepdims=True)
    shares = np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)
    return ExtraTrees(forest, shares, average_importances(gains))


def _side_counts(rows, dim: int, forest: Forest, tried: np.ndarray, cut: np.ndarray, classes: int) -> np.ndarray:
    """(trees, nodes, candidates, side, class) row counts for the trial thresholds."""
    n_trees, width, count = tried.shape
    base = width - 1
    shape = (n_trees, width, count, 2, classes)

    def partial(data):
        x = data[ARRAY]
        label = data["label"].astype(np.int64)
        at = forest.leaves(x) - base
        out = np.zeros((n_trees, width * count * 2 * classes))
        for t in range(n_trees):
            mine = np.where(at[:, t] >= 0)[0]
            node = at[mine, t]
            side = (x[mine[:, None], tried[t][node]] > cut[t][node]).astype(np.int64)
            slot = ((node[:, None] * count + np.arange(count)[None, :]) * 2 + side) * classes + label[mine][:, None]
            out[t] = np.bincount(slot.reshape(-1), minlength=out.shape[1])
        return out.reshape(-1)

    return partial_sums(rows, {ARRAY: dim}, ["label"], partial, int(np.prod(shape))).reshape(shape)


def fit_extra_trees(train: Features, seed: int = 0, n_trees: int = 100, depth: int | None = None):
    """A root of the columns tried per node; to purity unless a depth is given."""
    tried = max(1, int(train.dim**0.5))
    if depth is not None:
        return grow_extra_trees(train, tried, seed, n_trees, depth)
    from pipegrid.operators.deep_trees import grow_to_purity

    return grow_to_purity(train, tried, seed, n_trees)
