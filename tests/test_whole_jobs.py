"""Jobs that take all their input, beyond the size that one task or the driver holds."""

import re

import numpy as np
from pyspark.sql import functions as F

from pipegrid.frame import from_columns
from pipegrid.functions import joins
from pipegrid.llm import common, simhash
from pipegrid.operators import boosting, keyed, landmark
from pipegrid.operators.regress import keyed_partial_sums
from pipegrid.session import cut_lineage
from tests.conftest import matrix
from workload import sweeps


def test_kernel_pca_takes_all_rows_beyond_the_limit(separable):
    dense = matrix(landmark.fit_kernel_pca(separable.train(), components=20).apply(separable))[3]
    model = landmark.fit_kernel_pca(separable.train(), components=20, limit=60)
    rows, label, split, moved = matrix(model.apply(separable))
    assert np.abs(moved - dense).max() < 1e-7
    assert (rows == np.arange(len(rows))).all() and (label == rows % 2).all() and (split == "train").sum() == 268


def test_kernel_pca_of_repeated_and_equal_rows(spark):
    df = spark.range(0, 90, numPartitions=3).select(
        F.when(F.col("id") % 4 > 0, F.col("id") % 5).alias("row_id"),  # keys repeat and are null
        F.lit(0).alias("label"),
        F.lit("train").alias("split"),
        (F.col("id") % 7).cast("double").alias("a"),
        F.lit(1.0).alias("b"),
    )
    x = from_columns(df, ["a", "b"])
    values = {}
    for limit in (90, 40):  # seven distinct rows have six components
        made = landmark.fit_kernel_pca(x, components=10, limit=limit).apply(x)
        assert made.dim == 6 and made.df.count() == 90
        values[limit] = sorted(np.round(np.abs(r.features), 6).tolist() for r in made.df.collect())
    assert values[90] == values[40]
    line = from_columns(df.withColumn("a", F.col("a") / 300), ["a", "b"])  # eigenvalues down to a 1e-12th of the first
    made = [landmark.fit_kernel_pca(line, components=10, limit=limit) for limit in (90, 40)]
    scale = [m.apply(line).df.select(F.aggregate("features", F.lit(0.0), lambda s, v: s + v * v).alias("s")).agg(F.sum("s")).first()[0] for m in made]
    assert abs(scale[0] / scale[1] - 1) < 1e-6
    equal = from_columns(df.withColumn("a", F.lit(2.0)), ["a", "b"])
    assert landmark.fit_kernel_pca(equal, limit=40).apply(equal).dim == 0


def test_simhash_broadcasts_nothing(spark, monkeypatch):
    """Tables below the broadcast threshold, of which there are many, would all lie on the driver."""
    plans = []

    def seen(df, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df, **options)

    monkeypatch.setattr(simhash, "cut_lineage", seen)
    monkeypatch.setattr(common, "cut_lineage", seen)
    rows = [(i, " ".join(f"w{i // 3}x{j}" for j in range(40)) + (" more" if i % 3 else "")) for i in range(30)] + [(None, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = simhash.deduplicate(docs)
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert kept.count() < len(rows) and len(plans) > 6
    assert not [p for p in plans if "Broadcast" in p] and any("SortMergeJoin" in p for p in plans)


def test_checkpoint_computes_costly_rows_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    made = cut_lineage(spark.range(0, 50, numPartitions=2).mapInArrow(run, "id long"), free_shuffles=True, once=True)
    assert made.count() == 50 and calls.value == 50 and not made.storageLevel.useMemory


def test_keyed_sums_send_what_is_less(spark):
    """Vectors where a key's rows lie together, rows where keys of few rows are scattered; null keys are a key."""
    rows = [(None if i % 50 == 7 else f"k{i % 50}", [float(i), 1.0], [float(i % 3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, x array<double>, y array<double>")
    want = {}
    for key, x, y in rows:
        want[key] = want.get(key, 0) + np.array([x[0] * y[0]] * 9)
    for layout, vectors in ((df.repartition(8), False), (df.repartition(3, "key"), True)):
        made = keyed_partial_sums(layout, "key", {"x": 2, "y": 1}, lambda d: np.full(9, (d["x"][:, 0] * d["y"][:, 0]).sum()), 9)
        assert ("MapInArrow" in made._jdf.queryExecution().executedPlan().toString()) == vectors
        got = {r.key: r.v for r in made.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_sweep_draws_costs_after_rows_met_their_models(spark, monkeypatch, tmp_path):
    """Forty costs and a path a row are neither cached nor sent through a shuffle."""
    spark.range(1, 3_000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(joins.join_keyed, "__defaults__", (10_000, 10))  # as with many configurations
    monkeypatch.setattr(sweeps, "keep", kept := Kept())
    scores = sweeps.swept(spark, str(tmp_path), [keyed.LINEAR])
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert not {"costs", "sol", "features"} & set(kept.columns)
    lines = plan.split("\n")
    depth = {i: len(re.match(r"[ :+-]*", line)[0]) for i, line in enumerate(lines)}
    join = max(i for i, line in enumerate(lines) if "SortMergeJoin [config" in line)  # of rows and models
    left = next(i for i in range(join + 2, len(lines)) if depth[i] == depth[join + 1])  # where the models begin
    assert "costs(" in "".join(lines[:join]) and "costs(" not in "".join(lines[join:left])
    assert scores.count() == 48


class Kept:
    def __init__(self):
        self.columns = []

    def __call__(self, df):
        self.columns += df.columns
        return df.cache()


def test_tree_positions_stop_where_the_trees_do():
    """Rows go down as far as their tree is split, whatever room it has; (rows, outputs)."""
    rng = np.random.default_rng(3)
    x, column, threshold = rng.normal(size=(200, 3)), np.full((2, 31), -1), np.zeros((2, 31))
    column[1, :3], threshold[1, :3] = [2, 0, 1], [0.1, -0.2, 0.3]
    at = boosting.Round(column, threshold, np.zeros((2, 31, 1))).positions(x)
    right = x[:, 2] > 0.1
    assert (at[:, 0] == 0).all() and (at[:, 1] == np.where(right, 5 + (x[:, 1] > 0.3), 3 + (x[:, 0] > -0.2))).all()
