"""Boosting with histogram passes.

``fit_adaboost`` keeps no per-row state: a row's weight is a function of the stumps so
far, recomputed inside the pass. ``fit_boosted_trees`` boosts many outputs at once; its
row state is a column of predictions that is written to the checkpoint folder every few
rounds, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, Features
from pipegrid.functions.blocks import block_map, block_score, partial_sums
from pipegrid.functions.quantiles import column_quantiles
from pipegrid.session import cut_lineage, held, hold


def bin_edges(df: DataFrame, columns, max_bins: int) -> list[np.ndarray]:
    """Candidate thresholds per column: distinct quantiles, without the maximum."""
    probabilities = [i / max_bins for i in range(max_bins + 1)]
    return [np.unique(np.array(q, dtype=float))[:-1] for q in column_quantiles(df, columns, probabilities)]


def bin_codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Code k means edges[k-1] < x <= edges[k]."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)


# ---------------------------------------------------------------- AdaBoost


@dataclass(frozen=True)
class Stump:
    column: int
    threshold: float
    left: float  # half the log-odds of class 1 at or below the threshold
    right: float


@dataclass(frozen=True)
class StumpEnsemble:
    stumps: tuple[Stump, ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for s in self.stumps:
            total += np.where(x[:, s.column] <= s.threshold, s.left, s.right)
        return total

    def predict(self, features: Features) -> DataFrame:
        margin = block_score(self.margin, features.array(), features.dim)
        return features.df.select(*features.keys(), F.when(margin > 0, 1).otherwise(0).alias("y_pred"))


def _best_stump(table: np.ndarray, edges: list[np.ndarray]) -> Stump | None:
    """The split of least weighted Gini impurity; ``table`` is (columns, bins, classes)."""
    best, best_score = None, np.inf
    for j, e in enumerate(edges):
        if len(e) == 0:
            continue
        running = np.cumsum(table[j], axis=0)
        left, total = running[: len(e)], running[-1]
        right = total - left
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = sum(
                np.nan_to_num(side.sum(1) - (side**2).sum(1) / side.sum(1)) for side in (left, right)
            )
        impurity[(left.sum(1) <= 0) | (right.sum(1) <= 0)] = np.inf
        k = int(impurity.argmin())
        if impurity[k] < best_score - 1e-15:
            best_score = impurity[k]
            odds = [
                0.5 * np.diff(np.log(np.clip(side[k] / side[k].sum(), np.finfo(float).eps, None)))[0]
                for side in (left, right)
            ]
            best = Stump(j, float(e[k]), float(odds[0]), float(odds[1]))
    return best


def fit_adaboost(train: Features, seed: int = 0, rounds: int = 50, max_bins: int = 255) -> StumpEnsemble:
    """Real-valued boosting of depth-1 trees; one pass per round."""
    edges = bin_edges(train.df, train.elements(), max_bins)
    bins = max(len(e) for e in edges) + 1
    d = train.dim
    stumps: list[Stump] = []
    with held(train.with_array()) as rows:
        for _ in range(rounds):
            so_far = StumpEnsemble(tuple(stumps))

            def partial(data, so_far=so_far):
                x, label = data[ARRAY], data["label"].astype(np.int64)
                weight = np.exp(-np.where(label > 0, 1.0, -1.0) * so_far.margin(x))
                codes = bin_codes(x, edges)
                out = np.zeros((d, bins * 2))
                for j in range(d):
                    out[j] = np.bincount(codes[:, j] * 2 + label, weights=weight, minlength=bins * 2)
                return out.reshape(-1)

            table = partial_sums(rows, {ARRAY: d}, ["label"], partial, d * bins * 2).reshape(d, bins, 2)
            stump = _best_stump(table / table[0].sum(), edges)
            if stump is None:
                break
            stumps.append(stump)
            if max(abs(stump.left), abs(stump.right)) > 17.0 and stump.left * stump.right < 0:
                break  # both leaves are pure: nothing is left to learn
    return StumpEnsemble(tuple(stumps))


# ---------------------------------------------------------------- many outputs at once


@dataclass(frozen=True)
class Round:
    """One tree per output, in heap order."""

    column: np.ndarray  # (outputs, nodes), -1 at leaves
    threshold: np.ndarray
    leaf: np.ndarray  # (outputs, nodes, width): constant, or coefficients and constant

    def positions(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row and output, an output at a time, so that what is looked up stays in the processor's cache."""
        outputs, nodes = self.column.shape
        n = len(x)
        values, row = np.ascontiguousarray(x.T).reshape(-1), np.arange(n)
        at = np.zeros((outputs, n), dtype=np.int64)
        for column, threshold, mine in zip(self.column, self.threshold, at):
            for level in range(int(np.log2(nodes + 1)) - 1):
                if not (column[2**level - 1 : 2 ** (level + 1) - 1] >= 0).any():
                    break  # a tree is split level by level
                split = np.take(column, mine)
                right = np.take(values, np.maximum(split, 0) * n + row) > np.take(threshold, mine)
                mine[:] = np.where(split >= 0, 2 * mine + 1 + right, mine)
        return at.T

    def values(self, x: np.ndarray) -> np.ndarray:
        at = self.positions(x)
        which = np.arange(self.column.shape[0])[None, :]
        coefficients = self.leaf[which, at]
        if self.leaf.shape[2] == 1:
            return coefficients[..., 0]
        return (coefficients[..., :-1] * x[:, None, :]).sum(axis=2) + coefficients[..., -1]


@dataclass(frozen=True)
class BoostedTrees:
    start: np.ndarray
    rounds: tuple[Round, ...]
    rate: float

    def values(self, x: np.ndarray) -> np.ndarray:
        total = np.tile(self.start, (len(x), 1))
        for r in self.rounds:
            total += self.rate * r.values(x)
        return total

    def predict(self, instances: DataFrame, n_features: int, out: str = "predicted_costs") -> DataFrame:
        return instances.withColumn(out, block_map(self.values, F.col("features"), n_features))


CHECKPOINT_ROUNDS = 10


def fit_boosted_trees(
    instances: DataFrame,
    n_features: int,
    n_outputs: int,
    rounds: int = 100,
    rate: float = 0.3,
    depth: int = 6,
    max_bins: int = 64,
    min_leaf: int = 1,
    ridge: float = 1.0,
    linear_leaves: bool = False,
) -> BoostedTrees:
    """Squared-loss boosting of all outputs together, from rows with features, costs and split.

    Per round: one pass per level for the histograms of every output, and one for linear
    leaves if wanted.
    """
    train = instances.filter(F.col("split") == "train").select("features", "costs")
    arrays = {"features": n_features, "costs": n_outputs}
    edges = bin_edges(train, [F.col("features")[j] for j in range(n_features)], max_bins)
    bins = max(len(e) for e in edges) + 1
    total = partial_sums(
        train, arrays, [], lambda data: np.append(data["costs"].sum(axis=0), len(data["costs"])), n_outputs + 1
    )
    start = total[:-1] / total[-1]
    done: list[Round] = []
    # the costs column holds what is left to explain; a lost block is recomputed from the
    # last checkpoint through at most CHECKPOINT_ROUNDS narrow steps
    residual = block_map(lambda c: c - start, F.col("costs"), n_outputs)
    whole = hold(train.select("features", residual.alias("costs")))
    base = hold(_sized(whole))
    base.count()
    if base is not whole:
        whole.unpersist()
    previous = None
    for r in range(rounds):
        grown = _grow_round(base, arrays, edges, bins, depth, min_leaf, ridge)
        if linear_leaves:
            grown = _linear_leaves(base, arrays, grown, min_leaf)
        done.append(grown)
        if previous is not None:
            previous.unpersist()
        fresh = _explained(base, grown, rate, n_features, n_outputs)
        if (r + 1) % CHECKPOINT_ROUNDS == 0:
            fresh = cut_lineage(fresh)
        previous, base = base, hold(fresh)
    base.unpersist()
    previous.unpersist()
    return BoostedTrees(start, tuple(done), rate)


ROWS_PER_PARTITION = 5_000  # below this, merging histograms costs more than building them


def _sized(rows: DataFrame) -> DataFrame:
    """Partitions of cached rows by their number: none of them sends a histogram for a handful of rows."""
    needed = max(1, -(-rows.count() // ROWS_PER_PARTITION))
    present = rows.rdd.getNumPartitions()
    if needed < present:
        return rows.coalesce(needed)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(min(needed, cores)) if present < min(needed, cores) else rows


def _explained(base: DataFrame, grown: Round, rate: float, n_features: int, n_outputs: int) -> DataFrame:
    def left_over(both: np.ndarray) -> np.ndarray:
        x = both[:, :n_features]
        return both[:, n_features:] - rate * grown.values(x)

    joined = F.concat("features", "costs")
    return base.select("features", block_map(left_over, joined, n_features + n_outputs).alias("costs"))


def _grow_round(base, arrays, edges, bins, depth, min_leaf, ridge) -> Round:
    n_features, n_outputs = arrays["features"], arrays["costs"]
    nodes = 2 ** (depth + 1) - 1
    column = np.full((n_outputs, nodes), -1, dtype=np.int64)
    threshold = np.zeros((n_outputs, nodes))
    leaf = np.zeros((n_outputs, nodes, 1))
    for level in range(depth):
        width = 2**level
        first = width - 1
        current = Round(column.copy(), threshold.copy(), leaf)
        cells = width * bins

        def histogram(data, current=current, first=first, width=width, cells=cells):
            x, rest = data["features"], data["costs"]
            codes = bin_codes(x, edges)
            at = current.positions(x) - first
            out = np.zeros((n_outputs, n_features, 2, cells))
            for o in range(n_outputs):
                mine = np.where((at[:, o] >= 0) & (at[:, o] < width))[0]
                node = at[mine, o] * bins
                for j in range(n_features):
                    slot = node + codes[mine, j]
                    out[o, j, 0] = np.bincount(slot, weights=rest[mine, o], minlength=cells)
                    out[o, j, 1] = np.bincount(slot, minlength=cells)
            return out.reshape(-1)

        length = n_outputs * n_features * 2 * cells
        table = partial_sums(base, arrays, [], histogram, length)
        table = table.reshape(n_outputs, n_features, 2, width, bins)
        running = np.cumsum(table, axis=4)
        whole = running[..., -1:]
        left, right = running, whole - running
        gain = _score(left, ridge) + _score(right, ridge) - _score(whole, ridge)
        allowed = (left[:, :, 1] >= min_leaf) & (right[:, :, 1] >= min_leaf)
        for j, e in enumerate(edges):
            allowed[:, j, :, len(e) :] = False
        gain = np.where(allowed, gain, -np.inf).transpose(0, 2, 1, 3).reshape(n_outputs, width, -1)
        best = gain.argmax(axis=2)
        splits = np.take_along_axis(gain, best[..., None], axis=2)[..., 0] > 1e-12
        sums, counts = whole[:, 0, 0, :, 0], whole[:, 0, 1, :, 0]
        leaf[:, first : first + width, 0] = sums / np.maximum(counts + ridge, 1e-12)
        o, node = np.where(splits)
        j, b = best[o, node] // bins, best[o, node] % bins
        column[o, first + node] = j
        threshold[o, first + node] = [edges[c][k] for c, k in zip(j, b)]
        for side, child in ((left, 1), (right, 2)):
            at = 2 * (first + node) + child
            leaf[o, at, 0] = side[o, j, 0, node, b] / np.maximum(side[o, j, 1, node, b] + ridge, 1e-12)
        if len(o) == 0:
            break
    return Round(column, threshold, leaf)


def _score(part: np.ndarray, ridge: float) -> np.ndarray:
    """Sum squared over count plus ridge: the loss a constant leaf removes."""
    return part[:, :, 0] ** 2 / np.maximum(part[:, :, 1] + ridge, 1e-12)


def _linear_leaves(base, arrays, grown: Round, min_leaf: int) -> Round:
    """A least-squares plane per leaf, from summed normal equations; small leaves stay constant."""
    n_features, n_outputs = arrays["features"], arrays["costs"]
    nodes = grown.column.shape[1]
    p = n_features + 1
    used = np.zeros((n_outputs, nodes), dtype=bool)
    slots = np.zeros((n_outputs, nodes), dtype=np.int64)
    # leaves that can be reached: the root, and children of split nodes, that do not split
    reach = np.zeros((n_outputs, nodes), dtype=bool)
    reach[:, 0] = True
    for i in range(nodes // 2):
        inner = reach[:, i] & (grown.column[:, i] >= 0)
        reach[inner, 2 * i + 1] = reach[inner, 2 * i + 2] = True
    used = reach & (grown.column < 0)
    slots[used] = np.arange(int(used.sum()))
    n_slots = int(used.sum())

    def equations(data):
        x, rest = data["features"], data["costs"]
        wide = np.hstack([x, np.ones((len(x), 1))])
        at = grown.positions(x)
        products = wide[:, :, None] * wide[:, None, :]
        out = np.zeros((n_slots, p * p + p))
        for o in range(n_outputs):
            slot = slots[o, at[:, o]]
            low = int(slot.min())
            mine = slice(low, int(slot.max()) + 1)
            for k in range(p):
                for i in range(k + 1):
                    found = np.bincount(slot - low, products[:, k, i])
                    out[mine, k * p + i] += found
                    if i < k:
                        out[mine, i * p + k] += found
                out[mine, p * p + k] += np.bincount(slot - low, wide[:, k] * rest[:, o])
        return out.reshape(-1)

    total = partial_sums(base, arrays, [], equations, n_slots * (p * p + p)).reshape(n_slots, -1)
    leaf = np.zeros((n_outputs, nodes, p))
    leaf[..., -1] = grown.leaf[..., 0]
    for o, node in zip(*np.where(used)):
        row = total[slots[o, node]]
        a, b = row[: p * p].reshape(p, p), row[p * p :]
        if a[-1, -1] >= max(min_leaf, 2 * p):
            leaf[o, node] = np.linalg.lstsq(a, b, rcond=1e-10)[0]
    return Round(grown.column, grown.threshold, leaf)
