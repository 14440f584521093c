"""Trees to purity: by passes, in tasks, and through nodes too large for a task."""

import numpy as np
import pytest

from pipegrid.operators import deep_trees, select, trees
from pipegrid.sources import stages


@pytest.mark.parametrize("sizes", [{}, {"node_rows": 20, "first_levels": 3}, {"node_rows": 10, "first_levels": 2, "large_rows": 25}])
def test_leaves_are_pure_and_hold_every_row(separable, sizes):
    train = separable.train()
    model = deep_trees.grow_to_purity(train, 2, 5, 12, **sizes)
    leaves = model.leaves().collect()
    n = train.df.count()
    assert len({(r.tree, r.node) for r in leaves}) == len(leaves)
    for t in range(12):
        mine = np.array([r.counts for r in leaves if r.tree == t])
        assert mine.sum() == n and (np.minimum(mine[:, 0], mine[:, 1]) == 0).all()
    assert model.importances.sum() == pytest.approx(1) and (model.importances > 0).all()
    # distinct rows: every tree knows its training rows
    assert model.predict(train).filter("label <> y_pred").count() == 0
    if "large_rows" in sizes:
        assert any(p.count(":") > 0 for p in model.parts)
    made = model.predict(separable)
    right = made.filter("split = 'test'").selectExpr("avg(cast(label = y_pred as int)) as share").first().share
    assert made.count() == separable.df.count() and right > 0.85


def test_votes_equal_a_plain_walk(separable):
    train = separable.train()
    model = deep_trees.grow_to_purity(train, 2, 5, 4, node_rows=40, first_levels=2)
    subtrees = {r.node: r for r in model.subtrees.collect()}
    rows = separable.with_array().collect()
    got = {r.row_id: r.votes for r in model.votes(separable.with_array(), 6).collect()}
    for r in rows[:60]:
        total, x = np.zeros(2), np.array([r.features])
        for t in range(4):
            (node, _, shares), = model.parts[str(t)].walk(str(t), model.parts, x, np.arange(1))
            if shares is None:
                s, at = subtrees[node], 0
                while s.split_column[at] >= 0:
                    at = s.lower[at] + int(x[0, s.split_column[at]] > s.threshold[at])
                shares = np.array(s.counts[2 * at : 2 * at + 2])
                shares = shares / shares.sum()
            total += shares
        assert np.allclose(got[r.row_id], total)


def test_result_does_not_depend_on_the_partitioning(separable):
    from dataclasses import replace

    train = separable.train()
    one = deep_trees.grow_to_purity(train, 2, 3, 6, node_rows=60)
    two = deep_trees.grow_to_purity(replace(train, df=train.df.repartition(5)), 2, 3, 6, node_rows=60)
    key = lambda m: sorted((r.tree, r.node, tuple(r.counts)) for r in m.leaves().collect())
    assert key(one) == key(two) and np.allclose(one.importances, two.importances)


def test_rows_alike_with_different_labels_share_a_leaf():
    x = np.array([[1.0, 2.0]] * 4 + [[3.0, 2.0]] * 3)
    column, _, lower, counts, gains = deep_trees.finish(x, np.array([0, 1, 1, 0, 1, 1, 1]), 2, np.random.default_rng(1), 2)
    assert column[0] == 0 and column.count(-1) == 2 and gains[1] == 0
    assert {tuple(counts[lower[0]]), tuple(counts[lower[0] + 1])} == {(2.0, 2.0), (0.0, 3.0)}


def test_saved_and_loaded(spark, separable, tmp_path):
    model = trees.fit_extra_trees(separable.train(), 2, 5)
    stages.save_component(spark, model, str(tmp_path / "deep"))
    again = stages.load_component(spark, str(tmp_path / "deep"))
    assert again.predict(separable).exceptAll(model.predict(separable)).count() == 0
    assert {0, 3} <= set(select.fit_select_extra_trees(separable.train(), 1, 20).keep)


@pytest.mark.parametrize("n_trees, tried, node_rows", [(15, None, 1 << 17), (15, None, 40), (1, 5, 1 << 17), (1, 5, 40)])
def test_binned_trees_fit_their_rows(spark, n_trees, tried, node_rows):
    """Whatever passes and tasks split, a tree reproduces distinct rows; a task gets no node above the bound that can be split."""
    from pipegrid.frame import from_columns
    from pipegrid.operators import binned_trees

    draw = np.random.default_rng(1)
    x = np.round(draw.normal(size=(400, 5)), 2)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    y[:40] = draw.integers(0, 3, 40)
    names = list("abcde")
    df = spark.createDataFrame([(i, int(y[i]), "train", *map(float, x[i])) for i in range(400)], "row_id bigint, label int, split string, " + ", ".join(f"{c} double" for c in names))
    rows = from_columns(df, names)
    model = binned_trees.fit_binned_forest(rows, 3, n_trees, tried, node_rows)
    got = {r.row_id: r.y_pred for r in model.predict(rows).collect()}
    right = np.mean([got[i] == y[i] for i in range(400)])
    assert right == 1 if n_trees == 1 else right > 0.97
    dealt = binned_trees._dealt(rows.with_array(), model.cuts, model.tops, 3).groupBy("node").sum("weight").collect()
    assert max((r["sum(weight)"] for r in dealt), default=0) <= max(node_rows, 40) or node_rows > 400


def test_plain_forest_needs_few_jobs(spark, separable):
    """The number of jobs doesn't follow the depth of the trees."""
    from pipegrid.operators import forests

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plain", "")
    try:
        forests.fit_plain_forest(separable.train(), 1, 10)
        jobs = len(tracker.getJobIdsForGroup("plain"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert 0 < jobs <= 12


def test_binned_tree_equals_a_search_over_all_cuts():
    from pipegrid.operators import binned_trees

    draw = np.random.default_rng(2)
    bins, label, weight = draw.integers(0, 6, (80, 3)).astype(np.uint8), draw.integers(0, 3, 80), draw.integers(1, 4, 80)
    column, cut, *_ = binned_trees.finish(bins, label, weight, 3, np.random.default_rng(0), 3)
    gini = lambda m: weight[m].sum() - sum(weight[m & (label == k)].sum() ** 2 for k in range(3)) / max(weight[m].sum(), 1)
    worth = {(j, b): -gini(bins[:, j] <= b) - gini(bins[:, j] > b) for j in range(3) for b in range(5)}
    assert worth[int(column[0]), int(cut[0])] == pytest.approx(max(worth.values()))
