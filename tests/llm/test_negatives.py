import numpy as np
import pytest
from pyspark.sql import functions as F

from pipegrid.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """The contract, anchor by anchor over all scores."""
    clean = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        clean[vec_id] = (label, np.floor(256 * np.array(v, dtype=np.float32).astype(float)))
    out = set()
    for a, (own, q) in clean.items():
        if a % 100:
            continue
        width = len(q)
        scores = {b: int(q @ np.pad(p, (0, width))[:width]) for b, (_, p) in clean.items() if b != a}
        order = sorted(scores, key=lambda b: (-scores[b], b))
        for p in [b for b in order if clean[b][0] == own][:5]:
            band = [b for b in order if clean[b][0] != own and 30 * scores[p] <= 100 * scores[b] <= 90 * scores[p]]
            out |= {(a, p, r, n, scores[p], scores[n]) for r, n in enumerate(band[:10], 1)}
    return out


def mined(spark, rows, **extra):
    return {tuple(r) for r in negatives.mine(spark.createDataFrame(rows, SCHEMA)).collect()}


def table(rng, n, dims, hot=0.4):
    """Rows of very different lengths, a hot label, close groups, ties and zeros."""
    rows, centres = [], rng.normal(size=(6, dims))
    for i in range(n):
        v = centres[rng.integers(6)] * rng.choice([0.0, 0.1, 1, 1, 1, 30]) + rng.normal(size=dims) * rng.choice([0.01, 0.3])
        rows.append((int(i * 4 + rng.integers(4)), [float(np.float32(x)) for x in v], 0 if rng.random() < hot else int(rng.integers(10))))
    return rows


@pytest.mark.parametrize("seed, dims, size", [(1, 6, 50), (2, 16, 8192), (3, 3, 20)])
def test_equals_brute_force(spark, monkeypatch, seed, dims, size):
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives.in_blocks, "__defaults__", (size,))
    rows = table(np.random.default_rng(seed), 700, dims)
    rows += [(rows[k][0] + 4000, rows[k][1], rows[k][2]) for k in range(0, 60, 5)]  # equal vectors tie
    rows += [(9100, None, 1), (9200, [0.5] * dims, None), (9300, [float("nan")] + [0.0] * (dims - 1), 1), (9400, [None] * dims, 1)]
    rows += [(None, [0.5] * dims, 1), (9500, [float("inf")] * dims, 2), (9600, [0.0] * dims, 2)]
    rows += rows[:30]  # repeated rows
    assert mined(spark, rows) == plain(rows)


def test_no_row_that_can_reach_is_pruned():
    rng = np.random.default_rng(4)
    for _ in range(40):
        vectors = np.floor(rng.normal(size=(300, 5)) * rng.choice([5, 50, 500]))
        block = negatives.Block(vectors, focus=int(rng.integers(1, 6)))
        anchor = np.floor(rng.normal(size=5) * 100) + np.array([1, 0, 0, 0, 0])
        scores = vectors @ anchor
        for least in np.quantile(scores, [0.2, 0.6, 0.9, 0.99, 1.0]):
            assert set(np.flatnonzero(scores >= least)) <= set(block.candidates(anchor, float(least)).tolist())


def test_pruning_prunes():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 64))
    vectors = np.floor(256 * (centres[rng.integers(20, size=4000)] + 0.1 * rng.normal(size=(4000, 64))))
    block, anchor = negatives.Block(vectors), vectors[0]
    least = float(np.sort(vectors @ anchor)[-5])
    assert 5 <= len(block.candidates(anchor, least)) < 1000


def test_blocks_are_bounded_and_of_like_length(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, float(rng.integers(3))] if i < 900 else [float(10 ** rng.uniform(0, 6)), 0.0], 1) for i in range(1200)] + [(5000, [0.0, 0.0], 1)]
    usable = negatives.usable(spark.createDataFrame(rows, SCHEMA))
    placed, blocks = negatives.in_blocks(usable, 100)
    sizes = {r.block: r["count"] for r in placed.groupBy("block").count().collect()}
    assert sum(sizes.values()) == 1201 and max(sizes) < blocks <= 40 and max(sizes.values()) <= 140


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty).count() == 0
    assert mined(spark, [(100, [1.0, 0.0], 3)]) == set()  # an anchor alone
    assert mined(spark, [(1, [1.0], 3), (2, [1.0], 3)]) == set()  # no anchor
    # a shorter vector is filled up with zeros; one id with two vectors is two rows, none of them its own partner
    rows = [(100, [1.0, 1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.25, 0.2], 2), (100, [3.0, 0.0], 2)]
    named = spark.createDataFrame(rows, SCHEMA)
    for clash in ("row", "block", "v", "key", "lists"):
        named = named.withColumn(clash, F.lit("clash"))
    got = {tuple(r) for r in negatives.mine(named).collect()}
    assert got == {(100, 1, 1, 2, 65536, 128 * 256), (100, 1, 2, 3, 65536, 64 * 256 + 51 * 256)}
