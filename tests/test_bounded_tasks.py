"""Frequent keys and large batches must not end in one task or one large array."""

import hashlib
import math
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from pipegrid.functions import blocks
from pipegrid.functions.joins import join_keyed
from pipegrid.operators import landmark, neighbours
from pipegrid.sources.synthetic import cost_pattern, generate_costs


def uniform(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2.0**32


def test_costs_of_a_frequent_seed_need_no_shuffle(spark):
    """All rows of one seed stay in the partitions they came in."""
    rows = spark.range(0, 4000, numPartitions=8).select(F.col("id").alias("instance_id"), F.lit(4).alias("degree"), F.lit(0.5).alias("noise"), F.lit(7).alias("seed"))
    made = generate_costs(rows)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    sizes = made.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 8 and {r["count"] for r in sizes} == {500}


def test_costs_equal_their_formula(spark):
    rows = [(5, 2, 0.5, 1), (5, 2, 0.5, 1), (9, 6, 0.0, 2), (9, 1, 0.5, 2), (None, 2, 0.5, 1), (4, None, 0.5, 1), (4, 2, None, 1), (4, 2, 0.5, None)]
    made = generate_costs(spark.createDataFrame(rows, "instance_id long, degree int, noise double, seed int")).collect()
    assert len(made) == 7
    for r in made:
        if None in (r.instance_id, r.degree, r.noise):
            assert r.costs == [None] * 40
            continue
        for e, row in enumerate(cost_pattern(r.seed, 40)):
            dot = sum(a * b for a, b in zip(row, r.features))
            want = ((dot / math.sqrt(5) + 3) ** r.degree + 1) / 3.5**r.degree
            if r.noise:
                want *= 1 - r.noise + 2 * r.noise * uniform(f"noise{e}:{r.seed}:{r.instance_id}")
            assert math.isclose(r.costs[e], want, rel_tol=1e-12)


def test_join_of_frequent_keys_equals_the_plain_join(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 10 < 8, "a").when(F.col("id") % 10 == 8, F.concat(F.lit("k"), F.col("id") % 7)).alias("key"))
    keyed = rows.groupBy("key").agg(F.max("id").alias("top"))
    want = sorted(map(tuple, rows.join(keyed, "key").collect()))
    for few in (0, 1000):
        assert sorted(map(tuple, join_keyed(rows, keyed, "key", F.col("id"), 100, few).collect())) == want


def peak_mb(fn):
    tracemalloc.start()
    try:
        return fn(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_kernel_map_holds_a_slice(monkeypatch):
    """A full batch of 10,000 rows against 2,000 points never has its whole kernel matrix in memory."""
    rng = np.random.default_rng(1)
    points, weights, x = rng.normal(size=(2000, 6)), rng.normal(size=(2000, 20)), rng.normal(size=(10_000, 6))
    caught = []
    monkeypatch.setattr(landmark, "block_map", lambda fn, array, dim: caught.append(fn) or F)
    monkeypatch.setattr(landmark, "from_array", lambda *made: None)
    monkeypatch.setattr(F, "alias", lambda name: name, raising=False)

    class Source:
        dim, df = 6, type("Rows", (), {"select": staticmethod(lambda *c: None)})
        array, keys = (lambda self: None), (lambda self: [])

    means = landmark.rbf(points, points, 0.1).mean(axis=0)
    landmark.KernelMap(points, weights, 0.1, means, 0.5).apply(Source())
    got, mb = peak_mb(lambda: caught[0](x))
    k = landmark.rbf(x, points, 0.1)
    assert np.allclose(got, (k - means - k.mean(axis=1, keepdims=True) + 0.5) @ weights)
    assert mb < 60
    assert caught[0](x[:0]).shape == (0, 20)


def test_nearest_positions_copy_a_portion():
    rng = np.random.default_rng(2)
    known = rng.integers(0, 3, (60_000, 8)).astype(float)  # many ties, far apart
    x = rng.integers(0, 3, (200, 8)) + rng.choice([0.0, 0.25], (200, 8))
    (at, away), mb = peak_mb(lambda: neighbours.nearest_positions(x, known))
    squares = ((x[:, None, :] - known[None, :, :]) ** 2).sum(axis=2)
    assert (at == squares.argmin(axis=1)).all() and (away == squares.min(axis=1)).all()
    wide = rng.normal(size=(60_000, 64))
    _, mb = peak_mb(lambda: neighbours.nearest_positions(wide[:200], wide))
    assert mb < 50
    at, away = neighbours.nearest_positions(x, known, portion=7)
    assert (at == squares.argmin(axis=1)).all()


def test_few_small_vectors_of_a_cache_need_no_merge(spark, monkeypatch):
    monkeypatch.setattr(blocks, "expected_tasks", lambda df: 300)
    data = spark.range(0, 40, numPartitions=4).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features"))
    assert blocks.merge_levels(data, 2) == 1  # not cached: its partitions are guessed
    cached = data.cache()
    try:
        assert blocks.merge_levels(cached, 2) == 0
        assert blocks.merge_levels(cached, blocks.UNMERGED_DOUBLES) == 1
        total = blocks.partial_sums(cached, {"features": 2}, [], lambda d: d["features"].sum(axis=0), 2)
        assert total.tolist() == [40 * 39 / 2, 40]
    finally:
        cached.unpersist()
