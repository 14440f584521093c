"""Results must not depend on caps, and merges and shards must stay bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipegrid.frame import from_columns
from pipegrid.functions import blocks
from pipegrid.operators.linear import shards
from pipegrid.operators.scale import fit_power, yeo_johnson_likelihoods
from pipegrid.operators.trees import fit_extra_trees, grow_random_trees
from pipegrid.sources.synthetic import cost_pattern, cost_patterns, generate_costs


@pytest.fixture(scope="module")
def one_varies(spark):
    """64 columns of which one is not constant; it decides the label."""
    names = [f"c{j}" for j in range(64)]
    values = [F.lit(1.0).alias(c) if c != "c37" else (F.col("id") % 40).cast("double").alias(c) for c in names]
    rows = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 40 >= 20).cast("int").alias("label"), F.lit("train").alias("split"), *values)
    return from_columns(rows, names)


def test_random_trees_split_where_one_column_varies(one_varies):
    forest = grow_random_trees(one_varies, 3, n_trees=10, depth=3)
    assert (forest.column[:, 0] == 37).all()


def test_extra_trees_split_where_one_column_varies(one_varies):
    assert (fit_extra_trees(one_varies, 3, n_trees=20, depth=8).forest.column[:, 0] == 37).all()
    model = fit_extra_trees(one_varies, 3, n_trees=20)
    assert set(model.subtrees.selectExpr("split_column[0]").toPandas().iloc[:, 0]) == {37} and model.importances[37] == pytest.approx(1.0)
    assert model.predict(one_varies).filter("label <> y_pred").count() == 0


def test_power_finds_an_exponent_beyond_the_first_grid(spark):
    draw = np.random.default_rng(1).normal(size=3000)
    x = (1 - 20.0 * (0.02 + 0.004 * draw)) ** (-1 / 20.0) - 1  # its transform with exponent -20 is normal
    rows = [(i, 0, "train", float(v)) for i, v in enumerate(x)]
    train = from_columns(spark.createDataFrame(rows, "row_id long, label int, split string, x double"), ["x"])
    best = fit_power(train).lambdas[0]
    grid = np.linspace(-60, 20, 161)[None, :]
    likely = yeo_johnson_likelihoods(train, grid)
    assert best < -8
    assert yeo_johnson_likelihoods(train, np.array([[best]]))[0, 0] >= likely[np.isfinite(likely)].max() - 0.05


def test_seeds_are_not_bounded(spark):
    rows = spark.range(12_000).select(F.col("id").alias("instance_id"), F.col("id").cast("int").alias("seed"), F.lit(2).alias("degree"), F.lit(0.5).alias("noise"))
    assert generate_costs(rows).filter(F.size("costs") == 40).count() == 12_000
    got = spark.range(3).select("id", cost_patterns(F.col("id").cast("int"), 40).alias("p")).collect()
    assert all(r["p"] == cost_pattern(r["id"], 40) for r in got)


def test_every_shard_is_one_partition(spark):
    rows = shards(spark.range(5000).withColumnRenamed("id", "row_id"), 5).withColumn("p", F.spark_partition_id())
    found = rows.groupBy("__shard").agg(F.count_distinct("p").alias("n")).collect()
    assert len(found) == 8 and {r["n"] for r in found} == {1}
    assert rows.select("p").distinct().count() == 8


def test_merge_tasks_hold_few_vectors(spark, monkeypatch):
    """With hundreds of vectors neither a merge task nor the driver gets more than the fan-in."""
    monkeypatch.setattr(blocks, "expected_tasks", lambda df: 300)
    monkeypatch.setattr(blocks, "FAN_IN", 8)
    data = spark.range(0, 300, numPartitions=300).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features"))
    assert blocks.merge_levels(data) == 2
    total = blocks.partial_sums(data, {"features": 2}, [], lambda d: d["features"].sum(axis=0), 2)
    assert total.tolist() == [300 * 299 / 2, 300]
