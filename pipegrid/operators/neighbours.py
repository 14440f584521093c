"""Exact nearest-neighbour classification as a partitioned search.

Training rows are first reduced to distinct points (the lowest row_id speaks for all
copies). A few pivot points, chosen by hash, split them into cells with known radius.
A query row visits its own cell first; other cells only if the triangle inequality does
not rule them out. Crowded cells are cut into blocks of bounded size, and crowded query
groups into chunks, so no task ever holds a whole cell.

If the distinct training points fit a checked size, they are broadcast instead and the
queries need no shuffle at all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, Features
from pipegrid.functions.blocks import as_block
from pipegrid.functions.hashing import hash_bits
from pipegrid.session import cut_lineage, held

BROADCAST_DOUBLES = 8_000_000
MAX_PIVOTS = 4096
BLOCK_ROWS = 20_000
QUERY_ROWS = 20_000
KNOWN_ROWS = 8_192  # known rows that are copied and compared at once
SLICE_DOUBLES = 1_000_000  # distances held at once in a worker


@dataclass(frozen=True)
class NearestNeighbour:
    points: DataFrame  # features array<double>, point_id, label; distinct features
    dim: int
    n_points: int
    seed: int
    broadcast_doubles: int = BROADCAST_DOUBLES
    block_rows: int = BLOCK_ROWS
    query_rows: int = QUERY_ROWS

    def predict(self, features: Features) -> DataFrame:
        if self.n_points * (self.dim + 2) <= self.broadcast_doubles:
            return self._predict_broadcast(features)
        return self._predict_cells(features)

    def _predict_broadcast(self, features: Features) -> DataFrame:
        table = self.points.toArrow().combine_chunks()
        points = as_block(table.column(ARRAY), self.dim)
        ids = table.column("point_id").to_numpy()
        order = np.argsort(ids)  # argmin then picks the lowest id among equal distances
        shared = features.df.sparkSession.sparkContext.broadcast(
            (points[order], table.column("label").to_numpy()[order])
        )

        @F.arrow_udf("int")
        def nearest(values: pa.Array) -> pa.Array:
            known, labels = shared.value
            at, _ = nearest_positions(as_block(values, known.shape[1]), known)
            return pa.array(labels[at].astype(np.int32))

        return features.df.select(*features.keys(), nearest(features.array()).alias("y_pred"))

    def _predict_cells(self, features: Features) -> DataFrame:
        dim, block_rows, query_rows = self.dim, self.block_rows, self.query_rows
        pivot_rows = (
            self.points.orderBy(hash_bits(f"pivot:{self.seed}:", F.col("point_id")), "point_id")
            .limit(min(MAX_PIVOTS, max(16, math.isqrt(self.n_points))))
            .collect()
        )
        pivots = np.array([r[ARRAY] for r in pivot_rows])

        @F.arrow_udf("struct<cell: int, away: double>")
        def assign(values: pa.Array) -> pa.Array:
            at, away = nearest_positions(as_block(values, dim), pivots)
            return pa.StructArray.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(np.sqrt(away))], names=["cell", "away"]
            )

        placed = self.points.withColumn("__a", assign(ARRAY)).select(
            ARRAY, "point_id", "label", F.col("__a.cell").alias("cell"), F.col("__a.away").alias("away")
        )
        keys = features.keys()
        queries = features.with_array().withColumn("__a", assign(ARRAY)).select(
            *keys, ARRAY, F.col("__a.cell").alias("cell")
        )
        with held(placed) as placed, held(queries) as queries:
            cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
            radius = np.full(len(pivots), -1.0)
            blocks = np.zeros(len(pivots), dtype=int)
            for row in cells:
                radius[row["cell"]] = row["radius"]
                blocks[row["cell"]] = math.ceil(row["n"] / block_rows)
            load = {r["cell"]: math.ceil(r["count"] / query_rows) for r in queries.groupBy("cell").count().collect()}
            points = self._blocks(placed, blocks)
            own = self._search(queries, points, blocks, load)
            # upper bound from the own cell, then only cells that can beat or equal it
            bounded = queries.join(own.select("row_id", "best"), "row_id")
            rest = bounded.withColumn("cell", F.explode(_cells_within(pivots, radius, dim)(ARRAY, "best", "cell")))
            load_rest = {
                r["cell"]: math.ceil(r["count"] / query_rows) for r in rest.groupBy("cell").count().collect()
            }
            other = self._search(rest, points, blocks, load_rest)
            merged = own.select("row_id", "best", "point_id", "y_pred").unionByName(
                other.select("row_id", "best", "point_id", "y_pred")
            )
            answer = merged.groupBy("row_id").agg(
                F.min_by("y_pred", F.struct("best", "point_id")).alias("y_pred")
            )
            # the answer is written before the caches go, so that no search runs twice
            return cut_lineage(queries.select(*keys).join(answer, "row_id").select(*keys, "y_pred"))

    def _blocks(self, placed: DataFrame, blocks: np.ndarray) -> DataFrame:
        per_cell = F.lit(blocks.tolist())[F.col("cell")]
        return placed.withColumn("block", F.pmod(hash_bits("block:", F.col("point_id")), per_cell).cast("int"))

    def _search(self, queries, points, blocks, load) -> DataFrame:
        """Best point per query and block; both sides are cut so that a group is bounded."""
        dim = self.dim
        chunks = np.zeros(len(blocks), dtype=int)
        for cell, count in load.items():
            chunks[cell] = count
        n_blocks, n_chunks = F.lit(blocks.tolist())[F.col("cell")], F.lit(chunks.tolist())[F.col("cell")]
        # every query chunk meets every block of its cell: each side is repeated in place
        chunked = queries.withColumn("chunk", F.pmod(hash_bits("chunk:", F.col("row_id")), n_chunks).cast("int"))
        left = chunked.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks.cast("int") - 1)))
        left = left.select("cell", "block", "chunk", "row_id", ARRAY)
        asked = points.filter(n_chunks > 0)
        right = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks.cast("int") - 1)))
        right = right.select("cell", "block", "chunk", "point_id", "label", ARRAY)

        def search(rows: pa.Table, known: pa.Table) -> pa.Table:
            if rows.num_rows == 0 or known.num_rows == 0:
                return pa.table(
                    {
                        "row_id": pa.array([], pa.int64()),
                        "best": pa.array([], pa.float64()),
                        "point_id": pa.array([], pa.int64()),
                        "y_pred": pa.array([], pa.int32()),
                    }
                )
            ids = known.column("point_id").to_numpy()
            order = np.argsort(ids)
            at, away = nearest_positions(as_block(rows.column(ARRAY), dim), as_block(known.column(ARRAY), dim)[order])
            return pa.table(
                {
                    "row_id": rows.column("row_id").combine_chunks(),
                    "best": pa.array(away),
                    "point_id": pa.array(ids[order][at]),
                    "y_pred": pa.array(known.column("label").to_numpy()[order][at].astype(np.int32)),
                }
            )

        keys = ["cell", "block", "chunk"]
        found = (
            left.groupBy(*keys)
            .cogroup(right.groupBy(*keys))
            .applyInArrow(search, "row_id bigint, best double, point_id bigint, y_pred int")
        )
        nearest = F.min_by(F.struct("best", "point_id", "y_pred"), F.struct("best", "point_id")).alias("m")
        return found.groupBy("row_id").agg(nearest).select("row_id", "m.*")


def nearest_positions(rows: np.ndarray, known: np.ndarray, budget: int = 1_000_000, portion: int = KNOWN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest known row (lowest index on ties) and its squared distance.

    Squares are compared, because a root can make two different distances equal. The known rows are taken in portions,
    so that only one portion is copied and compared at a time.
    """
    at, away = _nearest_of(rows, known[:portion], budget)
    for start in range(portion, len(known), portion):
        found, gap = _nearest_of(rows, known[start : start + portion], budget)
        closer = gap < away  # on ties the earlier portion stays
        at[closer], away[closer] = found[closer] + start, gap[closer]
    return at, away


def _nearest_of(rows: np.ndarray, known: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.empty(len(rows), dtype=np.int64)
    away = np.empty(len(rows))
    step = max(1, budget // max(1, len(known)))
    # around their centre the squares are small, and so is what the short list must allow for rounding
    centre = known.mean(axis=0) if len(known) else 0.0
    moved = known - centre
    squares = (moved * moved).sum(axis=1)
    for start in range(0, len(rows), step):
        part = rows[start : start + step]
        # the expanded form only short-lists; the final distance is computed directly
        away_from = part - centre
        rough = squares - 2.0 * away_from @ moved.T
        low = rough.min(axis=1, keepdims=True)
        size = (away_from * away_from).sum(axis=1, keepdims=True)
        close = rough <= low + 1e-13 * known.shape[1] * (size + squares.max()) + 1e-300
        first = close.argmax(axis=1)
        gap = known[first] - part
        at[start : start + step] = first
        away[start : start + step] = (gap * gap).sum(axis=1)
        for i in np.where(close.sum(axis=1) > 1)[0]:
            near = np.where(close[i])[0]
            gap = known[near] - part[i]
            exact = (gap * gap).sum(axis=1)
            k = int(exact.argmin())
            at[start + i] = near[k]
            away[start + i] = exact[k]
    return at, away


def _cells_within(pivots: np.ndarray, radius: np.ndarray, dim: int):
    @F.arrow_udf("array<int>")
    def cells(values: pa.Array, best: pa.Array, own: pa.Array) -> pa.Array:
        x = as_block(values, dim)
        bound, mine = np.sqrt(best.to_numpy()), own.to_numpy()
        found = []
        step = max(1, SLICE_DOUBLES // len(pivots))
        squares = (pivots * pivots).sum(axis=1)
        for start in range(0, len(x), step):
            part = x[start : start + step]
            size = (part * part).sum(axis=1, keepdims=True)
            gap = np.sqrt(np.maximum(size + squares - 2.0 * part @ pivots.T, 0.0))
            # the expanded form is off by rounding: a cell too many costs time, one too few the answer
            slack = np.sqrt(1e-12 * (size + squares.max())) + 1e-12
            reach = (gap - radius <= bound[start : start + step, None] * (1 + 1e-9) + slack) & (radius >= 0)
            reach[np.arange(len(part)), mine[start : start + step]] = False
            found += [np.where(r)[0].astype(np.int32) for r in reach]
        return pa.array(found, pa.list_(pa.int32()))

    return cells


def fit_nearest_neighbour(train: Features, seed: int = 0, **limits) -> NearestNeighbour:
    """Distinct training points; among copies the lowest row_id gives the label."""
    points = (
        train.with_array()
        .groupBy(ARRAY)
        .agg(F.min("row_id").alias("point_id"), F.min_by("label", "row_id").alias("label"))
    )
    return NearestNeighbour(points, train.dim, points.count(), seed, **limits)
