"""Feature selection: chi-squared scores, importances, L1 coefficients."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pipegrid.frame import Features
from pipegrid.operators.class_stats import class_sums
from pipegrid.operators.columns import clamp_negatives

# fixed value: the chi-squared quantile with one degree of freedom at 1 - 0.1
CHI2_CUT_10_PERCENT = 2.705543454095404


class EmptySelection(ValueError):
    """No feature passed the test: the run fails and is recorded as failed."""


@dataclass(frozen=True)
class ColumnSelection:
    keep: tuple[int, ...]
    scores: tuple[float, ...] = ()
    clamp: bool = False

    def apply(self, features: Features) -> Features:
        if not self.keep:
            raise EmptySelection("no feature was selected")
        source = clamp_negatives(features) if self.clamp else features
        return source.select_columns(list(self.keep))


def chi2_scores(train: Features) -> np.ndarray:
    """Observed against expected per-class column sums; an all-zero column scores -inf."""
    _, counts, observed = class_sums(train)
    expected = np.outer(counts / counts.sum(), observed.sum(axis=0))
    with np.errstate(divide="ignore", invalid="ignore"):
        scores = ((observed - expected) ** 2 / expected).sum(axis=0)
    return np.where(np.isnan(scores), -np.inf, scores)


def fit_select_percentile(train: Features, seed: int = 0, percentile: float = 50.0) -> ColumnSelection:
    """Columns above the percentile of scores; ties at the cut are filled in column order."""
    scores = chi2_scores(clamp_negatives(train))
    if percentile >= 100:
        keep = range(train.dim)
    else:
        cut = _percentile(scores, 100.0 - percentile)
        chosen = scores > cut
        room = int(train.dim * percentile / 100.0) - int(chosen.sum())
        ties = np.where(scores == cut)[0][: max(room, 0)]
        chosen[ties] = True
        keep = np.where(chosen)[0].tolist()
    return ColumnSelection(tuple(keep), tuple(scores.tolist()), clamp=True)


def _percentile(values: np.ndarray, percent: float) -> float:
    finite = values[np.isfinite(values)]
    floor = finite.min() - 1.0 if len(finite) else 0.0
    return float(np.percentile(np.where(np.isfinite(values), values, floor), percent))


def fit_select_rates(train: Features, seed: int = 0) -> ColumnSelection:
    """Columns whose chi-squared p-value is under 0.1 (two classes, one degree of freedom)."""
    scores = chi2_scores(clamp_negatives(train))
    keep = np.where(scores > CHI2_CUT_10_PERCENT)[0].tolist()
    return ColumnSelection(tuple(keep), tuple(scores.tolist()), clamp=True)


def select_above_mean(importances: np.ndarray) -> ColumnSelection:
    keep = np.where(importances >= importances.mean())[0].tolist()
    return ColumnSelection(tuple(keep), tuple(importances.tolist()))


def fit_select_l1(train: Features, seed: int = 0) -> ColumnSelection:
    """Columns whose L1 squared-hinge coefficient reaches the mean magnitude."""
    from pipegrid.operators.linear import fit_l1_squared_hinge

    weights = fit_l1_squared_hinge(train)
    return select_above_mean(np.abs(weights[:-1]))


def fit_select_extra_trees(train: Features, seed: int = 0, n_trees: int = 100, depth: int | None = None) -> ColumnSelection:
    """Columns whose extra-trees importance (half of the columns tried per node) reaches the mean."""
    from pipegrid.operators.deep_trees import grow_to_purity
    from pipegrid.operators.trees import grow_extra_trees

    tried = max(1, int(0.5 * train.dim))
    forest = grow_to_purity(train, tried, seed, n_trees) if depth is None else grow_extra_trees(train, tried, seed, n_trees, depth)
    return select_above_mean(forest.importances)
