import numpy as np
import pytest
from pyspark.sql import functions as F

from pipegrid.functions import blocks
from pipegrid.operators import paths, regress
from pipegrid.operators.boosting import fit_boosted_trees
from pipegrid.operators.spo import fit_spo_plus
from pipegrid.plans.space import sweep_configs
from pipegrid.sources.synthetic import generate_costs, grid_edges, sweep_instances


def all_paths(grid):
    edges = {pair: e for e, pair in enumerate(grid_edges(grid))}
    rows, cols = grid
    out = []

    def walk(cell, path):
        if cell == rows * cols - 1:
            out.append(path)
            return
        for target in (cell + 1, cell + cols):
            if (cell, target) in edges:
                walk(target, [*path, edges[(cell, target)]])

    walk(0, [])
    return out


@pytest.mark.parametrize("grid", [(5, 5), (3, 4), (2, 6)])
def test_paths_equal_brute_force(grid):
    choices = all_paths(grid)
    costs = np.random.default_rng(1).uniform(0.1, 5, (50, len(grid_edges(grid))))
    chosen, objective = paths.solve_block(costs, grid)
    totals = np.array([[row[p].sum() for p in choices] for row in costs])
    assert np.allclose(objective, totals.min(1))
    for i, row in enumerate(chosen):
        assert sorted(np.where(row)[0]) == sorted(choices[int(totals[i].argmin())])


def test_ties_go_right_first():
    chosen, _ = paths.solve_block(np.ones((1, 40)))
    assert chosen[0][:4].tolist() == [1, 1, 1, 1]
    assert len(all_paths((5, 5))) == 70


def test_regret_rules(spark):
    opt, other = [1, 0], [0, 1]
    rows = [
        # equal solution with a rounding-negative regret counts 0; a different one keeps it
        ("a", opt, [1.0, 2.0], [1.0, 2.0], opt, 1.0 + 1e-3),
        ("b", other, [1.0, 2.0], [1.0, 0.5], opt, 1.0),
    ]
    df = spark.createDataFrame(
        rows, "k string, predicted_sol array<int>, predicted_costs array<double>, costs array<double>, sol array<int>, obj double"
    )
    got = {r["k"]: r for r in paths.evaluate(df, ["k"], 2).collect()}
    assert got["a"]["regret"] == 0.0 and got["a"]["mse"] == 0.0
    assert got["b"]["regret"] == -0.5 and got["b"]["mse"] == pytest.approx(1.5**2 / 2)


@pytest.fixture(scope="module")
def instances(spark):
    configs = sweep_configs(spark, [300], [1, 4], [0.0, 0.5], [1])
    return sweep_instances(configs, 100).cache()


def test_sweep_has_every_configuration(spark, instances):
    assert sweep_configs(spark, [100, 1000, 5000], [1, 2, 4, 6], [0.0, 0.5], list(range(1, 11))).count() == 240
    counts = instances.groupBy("config", "split").count().collect()
    assert {(r["split"], r["count"]) for r in counts} == {("train", 300), ("test", 100)} and len(counts) == 8


def test_costs_do_not_depend_on_partitions(spark):
    base = spark.range(50).select(
        F.col("id").alias("instance_id"), F.lit(2).alias("degree"), F.lit(0.5).alias("noise"), F.lit(3).alias("seed")
    )
    a = sorted(generate_costs(base.repartition(1)).select("instance_id", "costs").collect())
    b = sorted(generate_costs(base.repartition(6)).select("instance_id", "costs").collect())
    assert a == b


def evaluated(predicted):
    test = predicted.filter("split = 'test'")
    solved = paths.with_solution(test, "predicted_costs", "predicted_sol", "predicted_obj")
    return {r["config"]: r for r in paths.evaluate(paths.with_solution(solved), ["config"]).collect()}


def test_linear_regression_is_exact_on_linear_costs(instances):
    models = regress.fit_linear(instances, "config", 5, 40)
    scores = evaluated(regress.predict_linear(instances, "config", models, 5, 40))
    exact = next(r for c, r in scores.items() if "deg_1" in c and "noise_0.0" in c)
    assert exact["mse"] < 1e-20 and abs(exact["regret"]) < 1e-9
    assert all(r["regret"] > -1e-12 for r in scores.values())


def test_linear_regression_equals_numpy(instances, monkeypatch):
    monkeypatch.setattr(blocks, "FAN_IN", 2)  # sums in several levels
    assert blocks.merge_levels(instances) > 1
    config = instances.first()["config"]
    rows = instances.filter((F.col("config") == config) & (F.col("split") == "train")).collect()
    x = np.hstack([np.array([r["features"] for r in rows]), np.ones((len(rows), 1))])
    y = np.array([r["costs"] for r in rows])
    models = regress.fit_linear(instances.repartition(90), "config", 5, 40)
    got = np.array(models.filter(F.col("config") == config).first()["weights"]).reshape(6, 40)
    np.testing.assert_allclose(got, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-9)


def test_perfect_predictions_have_no_regret(instances):
    scores = evaluated(instances.withColumn("predicted_costs", F.col("costs")))
    # the two sums over one path may differ in the last bit
    assert all(abs(r["regret"]) < 1e-12 and r["mse"] == 0 for r in scores.values())


def test_spo_plus_lowers_loss_and_regret(instances):
    data = instances.filter("degree = 4 and noise = 0.5")
    model = fit_spo_plus(data, epochs=6)
    assert model.losses[-1] < 0.7 * model.losses[0]
    untrained = fit_spo_plus(data, epochs=0)
    after, before = (list(evaluated(m.predict(data)).values())[0]["regret"] for m in (model, untrained))
    assert after < before
    with pytest.raises(ValueError, match="optimizer"):
        fit_spo_plus(data, optimizer="adagrad")


@pytest.mark.parametrize("linear_leaves", [False, True])
def test_boosting_lowers_the_error_of_every_output(instances, linear_leaves):
    data = instances.filter("degree = 4 and noise = 0.0")
    model = fit_boosted_trees(
        data, 5, 40, rounds=12, depth=3, min_leaf=20 if linear_leaves else 1, ridge=1.0, linear_leaves=linear_leaves
    )
    test = data.filter("split = 'test'").collect()
    x = np.array([r["features"] for r in test])
    y = np.array([r["costs"] for r in test])
    base = ((y - model.start) ** 2).mean(0)
    assert (((y - model.values(x)) ** 2).mean(0) < 0.8 * base).all()
