"""Kernel PCA over all training rows, in blocks of rows: no task or driver ever holds the kernel matrix.

Rows travel as blocks of ``BLOCK_ROWS`` in bytes. The product of the kernel matrix with a tall matrix is dealt over lanes: a
lane holds the product of its own rows and reads all blocks one after the other, computing the kernel values as it goes. The work
is quadratic in the rows, memory is bounded, and shuffles hold as many copies of the blocks as there are lanes.

The leading eigenvectors of the centred matrix come from subspace iteration on a block twice as wide as wanted, with a
Rayleigh-Ritz step per product; only Gram matrices of that width reach the driver. It ends when every wanted pair's residual is
below ``TOLERANCE`` of its eigenvalue.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, Features, from_array
from pipegrid.functions.blocks import as_block, from_block, partial_sums
from pipegrid.session import cut_lineage

BLOCK_ROWS = 1024
LANE_ROWS = 1 << 14  # rows whose products a task holds
SLICE_DOUBLES = 1_000_000  # kernel values that a worker holds at once
PRODUCTS = 200  # products at most
TOLERANCE = 1e-7  # residual of an eigenpair, as a share of its eigenvalue; one product more follows
FLOOR = 1e-10  # and of the largest eigenvalue
RANK = 1e-12  # of the largest eigenvalue: what lies below counts as zero
NOISE = 1e-15  # of the matrix' trace, likewise

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, width)


def _frame(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.values())], names=list(schema))


def packed(features: Features) -> DataFrame:
    """(lane, keys, x): blocks of rows with all keys; ``lane`` is any number that deals them evenly."""
    keys, dim = features.keys(), features.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                some = pa.Table.from_batches([batch.slice(start, BLOCK_ROWS)])
                x = as_block(some[ARRAY], dim)
                yield _frame(_PACKED, [(n, _bytes(some.select(keys)), np.ascontiguousarray(x).tobytes())])
                n += 1

    blocks = features.with_array().mapInArrow(run, "nth long, keys binary, x binary")
    return blocks.select((F.col("nth") + F.spark_partition_id()).alias("lane"), "keys", "x")


_PACKED = {"nth": pa.int64(), "keys": pa.binary(), "x": pa.binary()}
_PRODUCT = {"keys": pa.binary(), "x": pa.binary(), "v": pa.binary(), "y": pa.binary()}


def product(left: DataFrame, right: DataFrame, lanes: int, dim: int, width: int, kernel: Kernel) -> DataFrame:
    """(keys, x, v, y): each block of ``left`` (lane, keys, x, v) with y, the kernel between its rows and all of ``right`` times their v.

    ``right`` has (x, v), v of ``width`` columns. The rows of ``left`` are held per lane, those of ``right`` a block at a time.
    """
    own = left.select(F.pmod("lane", F.lit(lanes)).cast("int").alias("lane"), F.lit(0).alias("kind"), "keys", "x", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    other = right.select(every, F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("keys"), "x", "v")
    dealt = own.unionByName(other).repartitionById(lanes, "lane").sortWithinPartitions("kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, x, y = [], None, None
        for batch in batches:
            for row in batch.to_pylist():
                if not row["kind"]:
                    held.append((row["keys"], row["x"], row["v"]))
                    continue
                if x is None:
                    x = np.concatenate([_matrix(h[1], dim) for h in held]) if held else np.zeros((0, dim))
                    y = np.zeros((len(x), width))
                points, v = _matrix(row["x"], dim), _matrix(row["v"], width)
                step = max(1, SLICE_DOUBLES // max(1, len(points)))
                for start in range(0, len(x), step):
                    y[start : start + step] += kernel(x[start : start + step], points) @ v
        start = 0
        for keys, own_x, v in held:
            end = start + len(own_x) // (8 * dim)
            yield _frame(_PRODUCT, [(keys, own_x, v, np.ascontiguousarray(y[start:end]).tobytes())])
            start = end

    return dealt.select("kind", "keys", "x", "v").mapInArrow(run, "keys binary, x binary, v binary, y binary")


def lanes_for(df: DataFrame, n: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-n // LANE_ROWS))


def _gram(blocks: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all rows of (v, v), (v, y), (y, y), v and y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v, y = (_matrix(row[c], width) for c in ("v", "y"))
                parts = [v.T @ v, v.T @ y, y.T @ y, v.sum(axis=0), y.sum(axis=0)]
                yield pa.RecordBatch.from_arrays([from_block(np.concatenate([p.reshape(-1) for p in parts])[None, :])], names=["g"])

    length = 3 * width * width + 2 * width
    total = partial_sums(blocks.select("v", "y").mapInArrow(run, "g array<double>"), {"g": length}, [], lambda d: d["g"].sum(axis=0), length)
    squares = total[: 3 * width * width].reshape(3, width, width)
    return *squares, total[-2 * width : -width], total[-width:]


def _turned(blocks: DataFrame, width: int, source: str, shift: np.ndarray, turn: np.ndarray) -> DataFrame:
    """(lane, keys, x, v): the blocks with v = (source - shift) @ turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                v = (_matrix(row[source], width) - shift) @ turn
                yield _frame(_TURNED, [(n, row["keys"], row["x"], np.ascontiguousarray(v).tobytes())])
                n += 1

    made = blocks.mapInArrow(run, "lane long, keys binary, x binary, v binary")
    return made.select((F.col("lane") + F.spark_partition_id()).alias("lane"), "keys", "x", "v")


_TURNED = {"lane": pa.int64(), "keys": pa.binary(), "x": pa.binary(), "v": pa.binary()}


def _drawn(row: dict, dim: int, width: int, seed: int) -> np.ndarray:
    """Random columns for a block, drawn from its content."""
    rng = np.random.default_rng([seed & 0xFFFFFFFF, zlib.crc32(row["keys"]), zlib.crc32(row["x"])])
    return rng.normal(size=(len(row["x"]) // (8 * dim), width))


def _begun(blocks: DataFrame, dim: int, width: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _frame(_TURNED, [(row["lane"], row["keys"], row["x"], _drawn(row, dim, width, seed).tobytes())])

    return blocks.mapInArrow(run, "lane long, keys binary, x binary, v binary")


@dataclass(frozen=True)
class RowKernelMap:
    """kernel(x, all training rows) times weights, less a shift; points and weights are blocks of a table."""

    points: DataFrame
    width: int
    shift: np.ndarray
    kernel: Kernel
    lanes: int

    def apply(self, features: Features) -> Features:
        keys, dim, width, shift = features.keys(), features.dim, self.width, self.shift
        left = packed(features).withColumn("v", F.lit(None).cast("binary"))
        made = product(left, self.points.select("x", "v"), self.lanes, dim, width, self.kernel)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    table = _table(row["keys"])
                    yield from table.append_column(ARRAY, from_block(_matrix(row["y"], width) - shift)).to_batches()

        types = dict(features.df.dtypes)
        schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"{ARRAY} array<double>"])
        return from_array(made.select("keys", "y").mapInArrow(run, schema), width)


def fit(train: Features, n: int, kernel: Kernel, components: int, seed: int) -> RowKernelMap | None:
    """Kernel PCA of ``n`` training rows; None if the centred matrix is zero."""
    dim, width = train.dim, min(2 * components, n)
    lanes = lanes_for(train.df, n)
    state = _begun(cut_lineage(packed(train)), dim, width, seed)
    settled = False
    for turns in range(PRODUCTS + 1):
        done = cut_lineage(product(state, state, lanes, dim, width, kernel), free_shuffles=True, once=True)
        vv, vy, yy, v_sum, y_sum = _gram(done, width)
        centre, mean = v_sum / n, y_sum / n
        centred = yy - n * np.outer(mean, mean)  # of the centred matrix times v, once v is centred
        if not turns:
            values, ritz = np.linalg.eigh(centred)
            kept = values > max(values[-1] * RANK, np.trace(yy) * NOISE)
            state = _turned(done, width, "y", mean, ritz[:, kept] / np.sqrt(values[kept]))
            if not kept.all():  # small eigenvalues drown in one product of random columns: go on with others across them
                state, width = _filled(state, int(kept.sum()), dim, width, n, seed + 1)
            continue
        values, ritz = _ritz(vv - n * np.outer(centre, centre), vy - n * np.outer(centre, mean))
        kept = values > max(values[0] * RANK, n * NOISE)
        values, ritz = values[kept], ritz[:, kept]
        if settled or turns == PRODUCTS or not kept.any():
            break
        missed = np.einsum("ij,ik,kj->j", ritz, centred, ritz) - values**2
        settled = (np.sqrt(np.maximum(missed, 0.0)) <= TOLERANCE * values + FLOOR * values[0])[:components].all()
        state, width = _turned(done, width, "y", mean, ritz / values), len(values)
    if not len(values):
        return None
    if not settled:
        warnings.warn(f"kernel components: not settled after {PRODUCTS} products", stacklevel=2)
    ritz = ritz[:, :components] * _signs(done, width, ritz[:, :components]) / np.sqrt(values[:components])
    # columns that sum to zero need no centring of the kernel's rows, only the mean of its columns
    points = cut_lineage(_turned(done, width, "v", centre, ritz))
    return RowKernelMap(points, ritz.shape[1], mean @ ritz, kernel, lanes)


def _filled(state: DataFrame, has: int, dim: int, width: int, n: int, seed: int) -> tuple[DataFrame, int]:
    """The blocks with random columns beside their ``has`` columns: ``width`` in all or as many as rows allow, centred and orthonormal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v = _matrix(row["v"], has) if has else np.zeros((len(row["x"]) // (8 * dim), 0))
                fresh = np.hstack([v, _drawn(row, dim, width - has, seed) / np.sqrt(n)])
                yield _frame(_TURNED, [(row["lane"], row["keys"], row["x"], fresh.tobytes())])

    both = cut_lineage(state.mapInArrow(run, "lane long, keys binary, x binary, v binary"))
    vv, _, _, v_sum, _ = _gram(both.withColumn("y", F.col("v")), width)
    norms, turn = np.linalg.eigh(vv - np.outer(v_sum, v_sum) / n)
    kept = norms > norms[-1] * RANK
    return _turned(both, width, "v", v_sum / n, turn[:, kept] / np.sqrt(norms[kept])), int(kept.sum())


def _ritz(vv: np.ndarray, vy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, of a symmetric matrix seen through columns v, and the columns' weights in its eigenvectors."""
    norms, turn = np.linalg.eigh((vv + vv.T) / 2)
    kept = norms > norms[-1] * RANK
    turn = turn[:, kept] / np.sqrt(norms[kept])
    values, vectors = np.linalg.eigh(turn.T @ (vy + vy.T) @ turn / 2)
    return values[::-1], (turn @ vectors)[:, ::-1]


def _signs(blocks: DataFrame, width: int, turn: np.ndarray) -> np.ndarray:
    """1 or -1 for every column of v @ turn, so that its largest loading is positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v = _matrix(row["v"], width) @ turn
                yield pa.RecordBatch.from_arrays([from_block(np.concatenate([-v.max(axis=0), v.min(axis=0)])[None, :])], names=["g"])

    length = 2 * turn.shape[1]
    least = partial_sums(blocks.select("v").mapInArrow(run, "g array<double>"), {"g": length}, [], lambda d: d["g"].min(axis=0), length, "min")
    high, low = np.split(-least, 2)
    return np.where(high >= low, 1.0, -1.0)
