import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipegrid.functions import blocks, ordered, quantiles
from pipegrid.functions.blocks import partial_sums
from pipegrid.functions.hashing import hash_normal, hash_uniform, local_normal, local_uniform
from pipegrid.operators.split import _kth_smallest, holdout_fraction, holdout_size


def test_hash_random_is_the_same_on_driver_and_executors(spark):
    row = spark.range(5, 6).select(hash_uniform("s:", F.col("id")).alias("u"), hash_normal("s:", F.col("id")).alias("z")).first()
    assert row["u"] == local_uniform("s:", 5)
    assert math.isclose(row["z"], local_normal("s:", 5), rel_tol=1e-12)


@pytest.fixture(scope="module")
def values(spark):
    draw = np.random.default_rng(3)
    v = np.concatenate([draw.normal(size=3000), np.full(2000, 0.5), draw.exponential(1e6, size=1000), [-1e9, 1e9]])
    w = np.where(np.arange(len(v)) % 3 == 0, 7.0, draw.integers(0, 5, len(v)))
    rows = [(i, int(i % 3 != 0), float(a), float(b)) for i, (a, b) in enumerate(zip(v, w))]
    return spark.createDataFrame(rows, "id bigint, g int, v double, w double").repartition(5).cache(), v, w


@pytest.mark.parametrize("rows_per_bucket", [50, 10**6])
def test_column_quantiles_by_ranges_equal_numpy(values, rows_per_bucket):
    df, v, w = values
    probabilities = [0.0, 0.0025, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.column_quantiles(df, [F.col("v"), F.col("w"), F.lit(None)], probabilities, builtin_values=0, rows_per_bucket=rows_per_bucket)
    np.testing.assert_allclose(got[0], np.quantile(v, probabilities), rtol=1e-12)
    np.testing.assert_allclose(got[1], np.quantile(w, probabilities), rtol=1e-12)
    assert got[2] == [None] * len(probabilities)
    assert quantiles.column_quantiles(df, [F.col("v")], probabilities)[0] == pytest.approx(got[0], rel=1e-12)


def jobs_of(spark, run) -> int:
    spark.sparkContext.setJobGroup("counted", "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    run()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return jobs


def test_jobs_of_quantiles_grow_with_neither_ranks_nor_columns(spark, values):
    df, _, _ = values
    ask = lambda columns, n: jobs_of(
        spark,
        lambda: quantiles.column_quantiles(df, [F.col("v") + i for i in range(columns)], [i / n for i in range(n + 1)], 0, 400),
    )
    few, many = ask(1, 3), ask(12, 1000)
    assert 0 < many <= few + 2


def test_one_order_value_in_half_of_all_rows_is_spread(spark):
    rows = spark.range(4000).select("id", F.lit("k").alias("k"), F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.col("id")).alias("o"))
    sizes = [r["count"] for r in ordered.in_ranges(rows, ["k", "o", "id"], 250).groupBy("__bucket").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 500
    numbered = ordered.row_number_in(rows, ["k"], "o", "id", "rn", rows_per_bucket=250).orderBy("rn").collect()
    want = sorted((r["o"], r["id"]) for r in numbered)
    assert [(r["o"], r["id"]) for r in numbered] == want and [r["rn"] for r in numbered] == list(range(1, 4001))


def test_grouped_quantiles_by_running_counts_equal_numpy(values):
    df, v, _ = values
    wanted = {"a": 0.1, "m": 0.5, "b": 0.97}
    got = quantiles.grouped_quantiles(df, ["g"], "v", wanted, builtin_values=0, rows_per_bucket=200)
    for row in got.collect():
        mine = v[(np.arange(len(v)) % 3 != 0) == bool(row["g"])]
        np.testing.assert_allclose([row["a"], row["m"], row["b"]], np.quantile(mine, [0.1, 0.5, 0.97]), rtol=1e-12)


def test_order_dependent_columns_across_buckets(values):
    df, v, _ = values
    whole = df.withColumn("hot", F.when(F.col("id") < 5000, "hot").otherwise("cold"))
    numbered = ordered.row_number_in(whole, ["hot"], "v", "id", "rn", rows_per_bucket=300)
    lagged = ordered.lag_in(numbered, ["hot"], "v", "id", "v", "prev", rows_per_bucket=300)
    rows = lagged.collect()
    for key in ("hot", "cold"):
        mine = sorted((r["v"], r["id"], r["rn"], r["prev"]) for r in rows if r["hot"] == key)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1))
        assert [m[3] for m in mine] == [None, *[m[0] for m in mine[:-1]]]


def test_running_sum_across_buckets(spark):
    df = spark.createDataFrame([(k, float(i), 1) for k in "ab" for i in range(500)], "k string, o double, n int")
    rows = ordered.running_sum(df, ["k"], "o", "n", "cum", rows_per_bucket=60).collect()
    assert all(r["cum"] == r["o"] + 1 for r in rows) and len(rows) == 1000


def test_partial_sums_in_one_and_two_levels(spark, monkeypatch):
    df = spark.range(1000).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    for parts, fan_in in ((3, 64), (80, 2)):
        monkeypatch.setattr(blocks, "FAN_IN", fan_in)
        total = partial_sums(df.repartition(parts), {"x": 2}, [], lambda d: d["x"].sum(axis=0), 2)
        assert total.tolist() == [499500.0, 1000.0]
        low = partial_sums(df.repartition(parts), {"x": 2}, [], lambda d: d["x"].min(axis=0), 2, "min")
        assert low.tolist() == [0.0, 1.0]


def test_holdout_is_exact_and_independent_of_partitions(spark):
    df = spark.range(1001).withColumnRenamed("id", "row_id")
    sides = [
        {r["row_id"] for r in holdout_fraction(df.repartition(p), 0.33, 9).filter("split = 'test'").collect()}
        for p in (1, 7)
    ]
    assert sides[0] == sides[1] and len(sides[0]) == math.ceil(0.33 * 1001)
    assert holdout_size(df, 5000, 1).filter("split = 'test'").count() == 1001
    assert holdout_size(df, 0, 1).filter("split = 'test'").count() == 0


def test_kth_smallest_with_tied_hashes(spark):
    rows = [(7, k) for k in range(300)] + [(3, 1000), (2**31 + 5, 1001)]
    df = spark.createDataFrame(rows, "u bigint, k bigint")
    assert _kth_smallest(df, 1, read_off=10) == (3, 1000)
    assert _kth_smallest(df, 101, read_off=10) == (7, 99)
    assert _kth_smallest(df, 302, read_off=10) == (2**31 + 5, 1001)
