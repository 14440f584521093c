import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipegrid.frame import from_columns
from pipegrid.operators import columns, expand, impute, labels, profile, project, scale, select
from tests.conftest import matrix


def table(spark, rows, names):
    data = [(i, i % 2, "train", *r) for i, r in enumerate(rows)]
    schema = "row_id bigint, label int, split string, " + ", ".join(f"{c} double" for c in names)
    return from_columns(spark.createDataFrame(data, schema), names)


@pytest.fixture(scope="module")
def odd(spark):
    """A constant column, a column with missing values, a zero row."""
    rows = [(5.0, None, 0.0), (5.0, 2.0, 1.0), (5.0, float("nan"), 3.0), (5.0, 4.0, 4.0)]
    return table(spark, rows, ["c", "m", "v"])


def test_imputer_fills_null_and_nan(odd):
    _, _, _, x = matrix(impute.fit_mean_imputer(odd).apply(odd))
    assert x[:, 1].tolist() == [3.0, 2.0, 3.0, 4.0]


def test_imputer_rejects_empty_column(spark):
    bad = table(spark, [(1.0, None), (2.0, None)], ["a", "b"])
    with pytest.raises(ValueError, match="without any value"):
        impute.fit_mean_imputer(bad)


def test_scalers_on_constant_column(odd):
    x = impute.fit_mean_imputer(odd).apply(odd)
    for fit in (scale.fit_standard, scale.fit_min_max, scale.fit_robust_quartiles, scale.fit_quantile_map, scale.fit_power):
        _, _, _, done = matrix(fit(x).apply(x))
        assert np.allclose(done[:, 0], 0.0), fit.__name__


def test_standard_and_min_max_moments(separable):
    for fit, low in ((scale.fit_standard, None), (scale.fit_min_max, 0.0)):
        _, _, split, x = matrix(fit(separable.train()).apply(separable))
        train = x[split == "train"]
        if low is None:
            assert np.allclose(train.mean(0), 0) and np.allclose(train.std(0), 1)
        else:
            assert np.allclose(train.min(0), 0) and np.allclose(train.max(0), 1)


def test_scaling_does_not_depend_on_partitions(separable):
    a = matrix(scale.fit_standard(separable.train()).apply(separable))[3]
    moved = from_columns(separable.df.repartition(7), separable.names)
    assert np.allclose(a, matrix(scale.fit_standard(moved.train()).apply(moved))[3], atol=1e-12)


def test_normalizer_keeps_zero_row(spark):
    x = table(spark, [(3.0, 4.0), (0.0, 0.0)], ["a", "b"])
    assert matrix(scale.fit_normalizer(x).apply(x))[3].tolist() == [[0.6, 0.8], [0.0, 0.0]]


def test_quantile_map_on_ties(spark):
    x = table(spark, [(v,) for v in [1.0, 2.0, 2.0, 2.0, 3.0]], ["a"])
    assert matrix(scale.fit_quantile_map(x).apply(x))[3][:, 0].tolist() == [0.0, 0.5, 0.5, 0.5, 1.0]
    outside = table(spark, [(0.0,), (9.0,), (2.5,)], ["a"])
    assert matrix(scale.fit_quantile_map(x).apply(outside))[3][:, 0].tolist() == [0.0, 1.0, 0.875]


def test_power_transform_finds_the_likelihood_maximum(spark):
    draw = np.random.default_rng(0)
    v = np.concatenate([draw.exponential(2.0, 200), -draw.exponential(0.5, 50)])
    x = table(spark, [(float(a),) for a in v], ["a"])
    fitted = scale.fit_power(x)

    def likelihood(lam):
        t = scale._yeo_johnson_block(v[:, None], np.array([lam]))[:, 0]
        return -len(v) / 2 * math.log(t.var()) + (lam - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()

    grid = np.linspace(-4, 4, 80001)
    best = grid[int(np.argmax([likelihood(g) for g in grid[::40]])) * 40]
    assert abs(fitted.lambdas[0] - best) < 5e-3
    done = matrix(fitted.apply(x))[3][:, 0]
    assert abs(done.mean()) < 1e-8 and abs(done.std() - 1) < 1e-8


def test_labels(spark):
    df = spark.createDataFrame([(1, "no"), (2, "yes"), (3, "no")], "id int, y string")
    assert [r["label"] for r in labels.encode_label(df, "y").orderBy("id").collect()] == [0, 1, 0]
    flags = spark.createDataFrame([(1, True), (2, False)], "id int, y boolean")
    assert [r["label"] for r in labels.encode_label(flags, "y").orderBy("id").collect()] == [1, 0]
    with pytest.raises(ValueError, match="two classes"):
        labels.encode_label(df.filter("y = 'no'"), "y")
    with pytest.raises(ValueError, match="more than two"):
        labels.encode_label(df.unionByName(spark.createDataFrame([(4, "maybe"), (5, "zz")], "id int, y string")), "y")
    with pytest.raises(TypeError):
        labels.encode_label(df.withColumn("y", F.array("y")), "y")


def test_profile_counts_cells_columns_rows(odd):
    row = profile.dataset_profile(odd.df, list(odd.names), "d").first()
    assert (row["n_rows"], row["n_nans"], row["n_cols_with_nans"], row["n_rows_with_nans"]) == (4, 2, 1, 2)


def test_chi2_ranks_zero_column_last_and_fills_ties(spark):
    rows = [(0.0, 1.0, 2.0, 2.0), (0.0, 3.0, 2.0, 2.0), (0.0, 1.0, 2.0, 2.0), (0.0, 3.0, 2.0, 2.0)]
    x = table(spark, rows, list("abcd"))
    scores = select.chi2_scores(x)
    assert scores[0] == -np.inf and scores[1] > scores[2] == scores[3]
    assert select.fit_select_percentile(x).keep == (1, 2)


def test_selection_by_rate_can_be_empty(spark):
    x = table(spark, [(1.0, 1.0)] * 4, ["a", "b"])
    chosen = select.fit_select_rates(x)
    assert chosen.keep == ()
    with pytest.raises(select.EmptySelection):
        chosen.apply(x)


def test_polynomial_in_both_layouts(spark):
    x = table(spark, [(2.0, 3.0)], ["a", "b"])
    assert matrix(expand.fit_polynomial(x).apply(x))[3][0].tolist() == [1, 2, 3, 4, 6, 9]
    wide = table(spark, [tuple(float(i) for i in range(15))], [f"f_{i}" for i in range(15)])
    made = expand.fit_polynomial(wide).apply(wide)
    assert made.dim == 16 * 17 // 2
    got = matrix(made)[3][0]
    v = np.arange(15.0)
    left, right = np.triu_indices(15)
    assert got.tolist() == [1.0, *v, *(v[left] * v[right])]


def test_fourier_features_approximate_the_kernel(separable):
    made = expand.fit_fourier(separable.train(), 3, gamma=0.05, components=2000).apply(separable)
    x, z = matrix(separable)[3][:40], matrix(made)[3][:40]
    away = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-0.05 * away)).max() < 0.12


def test_pca_matches_numpy(separable):
    _, _, split, x = matrix(separable)
    fitted = project.fit_pca(separable.train())
    train = x[split == "train"]
    values = np.linalg.eigvalsh(np.cov(train.T))[::-1]
    moved = matrix(fitted.apply(separable))[3][split == "train"]
    assert np.allclose(moved.var(0, ddof=1), values[: moved.shape[1]])


def test_ica_separates_sources(spark):
    draw = np.random.default_rng(1)
    sources = draw.uniform(-1.7, 1.7, (1500, 2))
    angle = 0.6
    mixed = sources @ np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
    x = table(spark, [tuple(map(float, r)) for r in mixed], ["a", "b"])
    found = matrix(project.fit_ica(x).apply(x))[3]
    match = np.abs(np.corrcoef(np.hstack([found, sources]).T)[:2, 2:])
    assert match.max(axis=1).min() > 0.98


def test_agglomeration_merges_copies(spark):
    draw = np.random.default_rng(2)
    a, b = draw.normal(size=50), draw.normal(size=50)
    x = table(spark, [(float(p), float(q), float(p) + 0.01, float(q) - 0.01) for p, q in zip(a, b)], list("abcd"))
    assert project.fit_agglomeration(x, clusters=2).groups == ((0, 2), (1, 3))


def test_report_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (1.0, 1.0), (1.0, 1.005)], "a double, b double")
    plain = [r[0] for r in df.select(columns.winner(F.col("a"), F.col("b"), ("x", "y"))).collect()]
    loose = [r[0] for r in df.select(columns.winner(F.col("a"), F.col("b"), ("x", "y"), 0.01)).collect()]
    assert plain == ["y", "x", "draw", "y"] and loose == ["y", "x", "draw", "draw"]
    assert columns.drop_unnamed(df).columns == ["a", "b"]
