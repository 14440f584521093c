import numpy as np
import pytest

from pipegrid.frame import from_columns
from pipegrid.operators import bayes, boosting, discriminant, forests, landmark, linear, mlp, neighbours, select, trees
from tests.conftest import matrix


def accuracy(model, features, side="test"):
    rows = [r for r in model.predict(features).collect() if r["split"] == side]
    return np.mean([r["label"] == r["y_pred"] for r in rows])


@pytest.mark.parametrize(
    "fit",
    [
        bayes.fit_gaussian_nb,
        bayes.fit_bernoulli_nb,
        neighbours.fit_nearest_neighbour,
        discriminant.fit_lda,
        discriminant.fit_qda,
        forests.fit_decision_tree,
        lambda t, s: forests.fit_random_forest(t, s, 20),
        lambda t, s: trees.fit_extra_trees(t, s, 30, 6),
        lambda t, s: boosting.fit_adaboost(t, s, 20),
        lambda t, s: forests.fit_gradient_boosting(t, s, 10),
        linear.fit_squared_hinge,
        linear.fit_logistic,
        linear.fit_passive_aggressive,
        landmark.fit_kernel_svm,
        lambda t, s: mlp.fit_mlp(t, s, epochs=60, batch=20, rate=1e-2),
    ],
)
def test_classifiers_learn_a_separable_table(separable, fit):
    assert accuracy(fit(separable.train(), 5), separable) > 0.85


def test_nearest_neighbour_by_cells_equals_brute_force(spark):
    draw = np.random.default_rng(5)
    x = np.round(draw.normal(size=(900, 3)), 1)
    x[200:500] = x[0]  # a third of the rows are copies of one point
    label = draw.integers(0, 2, len(x))
    rows = [(i, int(label[i]), "train" if i % 3 else "test", *map(float, x[i])) for i in range(len(x))]
    data = from_columns(
        spark.createDataFrame(rows, "row_id bigint, label int, split string, a double, b double, c double"), ["a", "b", "c"]
    )
    known = [i for i in range(len(x)) if i % 3]
    expected = {}
    for i in range(len(x)):
        away = ((x[known] - x[i]) ** 2).sum(1)
        expected[i] = label[known[int(away.argmin())]]
    plain = neighbours.fit_nearest_neighbour(data.train(), 3)
    cells = neighbours.fit_nearest_neighbour(data.train(), 3, broadcast_doubles=0, block_rows=7, query_rows=20)
    for model in (plain, cells):
        got = {r["row_id"]: r["y_pred"] for r in model.predict(data).collect()}
        assert got == expected


def test_squared_hinge_reaches_a_stationary_point(separable):
    model = linear.fit_squared_hinge(separable.train())
    start = np.linalg.norm(linear.squared_hinge_gradient(separable.train(), np.zeros(7)))
    assert np.linalg.norm(linear.squared_hinge_gradient(separable.train(), model.weights)) < 1e-5 * start


def test_l1_hinge_satisfies_the_optimality_conditions(separable):
    w = linear.fit_l1_squared_hinge(separable.train(), c=0.05)
    slope = linear.squared_hinge_gradient(separable.train(), w, 0.05) - w
    for value, s in zip(w, slope):
        assert abs(s + np.sign(value)) < 1e-3 if value else abs(s) <= 1 + 1e-3
    assert (w == 0).any()


def test_selectors_find_the_shifted_columns(separable):
    assert {0, 3} <= set(select.fit_select_extra_trees(separable.train(), 1, 30, 5).keep)
    assert {0, 3} <= set(select.fit_select_l1(separable.train()).keep)


def test_wide_and_narrow_layouts_agree(separable):
    from pipegrid.frame import Features

    wide = Features(separable.with_array(), (), 6)
    for fit in (bayes.fit_gaussian_nb, bayes.fit_multinomial_nb, discriminant.fit_lda):
        a = {r["row_id"]: r["y_pred"] for r in fit(separable.train()).predict(separable).collect()}
        b = {r["row_id"]: r["y_pred"] for r in fit(wide.train()).predict(wide).collect()}
        assert a == b


def test_class_statistics_of_wide_tables(spark):
    from pipegrid.operators.class_stats import class_moments, class_sums

    draw = np.random.default_rng(0)
    x = draw.normal(size=(60, 130))
    names = [f"f_{j}" for j in range(130)]
    rows = [(i, i % 2, "train", *map(float, x[i])) for i in range(60)]
    data = from_columns(
        spark.createDataFrame(rows, "row_id bigint, label int, split string, " + ", ".join(f"{c} double" for c in names)), names
    )
    classes, counts, sums = class_sums(data)
    assert classes == [0, 1] and np.allclose(sums[1], x[1::2].sum(0))
    _, _, means, variances, overall = class_moments(data)
    assert np.allclose(means[0], x[::2].mean(0)) and np.allclose(variances[0], x[::2].var(0))
    assert np.allclose(overall, x.var(0))


def test_random_trees_embedding_is_one_leaf_per_tree(separable):
    made = trees.fit_random_trees_embedding(separable.train(), 2).apply(separable)
    _, _, split, x = matrix(made)
    assert set(x[split == "train"].sum(1)) == {10.0} and (x.sum(0) > 0).all()


def test_kernel_maps_reproduce_the_kernel(separable):
    _, _, split, x = matrix(separable)
    n = int((split == "train").sum())
    z = matrix(landmark.fit_nystroem(separable.train(), components=n).apply(separable))[3][split == "train"]
    clamped = np.maximum(x[split == "train"], 0.0)
    away = ((clamped[:, None] - clamped[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-away)).max() < 1e-5
    moved = matrix(landmark.fit_kernel_pca(separable.train()).apply(separable))[3][split == "train"]
    assert moved.shape[1] == 100 and np.allclose(moved.mean(0), 0, atol=1e-8)
    products = moved.T @ moved
    assert np.abs(products - np.diag(np.diag(products))).max() < 1e-6


def test_adaboost_first_stump_is_the_best_gini_split(separable):
    model = boosting.fit_adaboost(separable.train(), rounds=1)
    _, label, split, x = matrix(separable)
    x, label = x[split == "train"], label[split == "train"]

    def impurity(j, t):
        parts = [label[x[:, j] <= t], label[x[:, j] > t]]
        return sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in parts if len(p))

    stump = model.stumps[0]
    best = min(impurity(j, t) for j in range(6) for t in x[:, j])
    assert impurity(stump.column, stump.threshold) <= best * 1.03
