"""SimHash near-duplicates: fingerprints, a grid join on segment bit counts, exact check, components.

A fingerprint is cut into six groups of ten or eleven bits. In a group, every bit and its right neighbour (the last
bit's is the first) form a segment, and the segment's bit counts (0, 1 or 2) are the group's grid coordinates. A bit
lies in two segments, so the Manhattan distance of two embeddings is at most twice the Hamming distance, and a group
without differing bits has equal coordinates. With at most four differing bits at least two of the six groups have
none: every linked pair meets in one of the fifteen grid cells made of two groups. The bit counts of whole groups
bound the distance from below once more, then the bits themselves decide.

Equal fingerprints are one node. In each cell, members first link to the cell's least member when they are near it,
which joins a dense group of near copies with as many links as members; only members of different components are then
compared with each other.

No join is a broadcast: tables that are small enough for one come many times, and would gather on the driver.

Nulls and empty texts get fingerprint zero and link like any other. Rows with equal id and text are one document
for :func:`deduplicate`. A component without any id has a null component_id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipegrid.llm.common import byte_chunks, components, row_key
from pipegrid.session import cut_lineage

WORDS = 4  #: words per shingle
SEED = 42
GROUPS = [(64 * g // 6, 64 * (g + 1) // 6) for g in range(6)]
MAX_BITS = 4  #: what six groups allow: two of them stay free of differing bits


def _hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles of a text, a piece at a time."""
    carry: list[bytes] = []
    hashed = False
    for piece in byte_chunks(text.encode("utf-8", "replace").lower()):
        found = carry + piece.split()
        if len(found) >= words:
            joined = b" ".join(found)
            ends = list(itertools.accumulate(len(w) + 1 for w in found))
            starts = [0, *ends]
            hashed = True
            yield np.fromiter((xxhash.xxh64_intdigest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[words - 1 :])), np.uint64)
            carry = found[len(found) - words + 1 :]
        else:
            carry = found
    if not hashed and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one text, as a signed integer; 0 without words."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in _hashes(text or "", words):
        for start in range(0, len(hashes), 1 << 14):
            part = hashes[start : start + (1 << 14)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0]) if total else 0


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(row, doc_id, fp) of ``docs`` with ``doc_id`` and ``text``."""
    return docs.select(row_key().alias("row"), "doc_id", _fingerprints("text").alias("fp"))


def _bits(first: int, last: int) -> str:
    """The bits first..last-1 of fp as a number."""
    return f"(shiftrightunsigned(fp, {first}) & {(1 << (last - first)) - 1}L)"


def _cell(first: int, last: int) -> str:
    """The group's segment bit counts as digits to base three."""
    pairs = [(i, i + 1 if i + 1 < last else first) for i in range(first, last)]
    return " + ".join(f"{3**k}L * ((shiftrightunsigned(fp, {i}) & 1L) + (shiftrightunsigned(fp, {j}) & 1L))" for k, (i, j) in enumerate(pairs))


def _distance(x: str, y: str) -> Column:
    return F.expr(f"bit_count({x}.fp ^ {y}.fp)")


def _in_cells(prints: DataFrame) -> DataFrame:
    """Each fingerprint once for each of its fifteen cells, with all six coordinates and bit counts."""
    placed = prints.select(
        "fp",
        F.array(*[F.expr(_cell(*g)) for g in GROUPS]).alias("at"),
        F.array(*[F.expr(f"bit_count({_bits(*g)})") for g in GROUPS]).alias("ones"),
    )
    cells = [
        F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), (F.lit((6 * p + q) << 38) + F.col("at")[p] * 177147 + F.col("at")[q]).alias("cell"))
        for p, q in itertools.combinations(range(6), 2)
    ]
    return placed.select("fp", "at", "ones", F.explode(F.array(*cells)).alias("c")).select("fp", "at", "ones", "c.*")


def links(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(node, component) of distinct fingerprints ``fp`` that have a link; others have no row."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"bits must be 0 to {MAX_BITS}")
    cells = _in_cells(prints)
    heads = cells.groupBy("cell").agg(F.min("fp").alias("head"), F.count("*").alias("n")).filter("n > 1").select("cell", "head")
    shared = cut_lineage(cells.join(heads.hint("merge"), "cell"))
    stars = components(shared.filter((F.col("fp") != F.col("head")) & (F.expr("bit_count(fp ^ head)") <= bits)).select(F.col("fp").alias("a"), F.col("head").alias("b")).distinct())
    named = shared.join(stars.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    mixed = named.groupBy("cell").agg(F.min("group").alias("least"), F.max("group").alias("most")).filter("least <> most").select("cell")
    named = cut_lineage(named.join(mixed.hint("merge"), "cell").select("cell", "p", "q", "fp", "at", "ones", "group"))
    x, y = named.alias("x"), named.alias("y")
    first = [(F.col("x.at")[g] != F.col("y.at")[g]) | (F.col("x.q") <= g) | (F.col("x.p") == g) for g in range(5)]
    lower = sum((F.abs(F.col("x.ones")[g] - F.col("y.ones")[g]) for g in range(1, 6)), F.abs(F.col("x.ones")[0] - F.col("y.ones")[0]))
    near = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.group") < F.col("y.group")) & (lower <= bits) & (_distance("x", "y") <= bits)
    for once in first:  # a pair that meets in several cells is taken in the first
        near = near & once
    crossing = x.join(y.hint("merge"), near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    spokes = stars.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(spokes.unionByName(crossing))


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(row, doc_id, fp, component, component_id) of every document of ``docs``."""
    prints = cut_lineage(fingerprints(docs), once=True)
    linked = links(prints.select("fp").distinct(), bits)
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = firsts.join(linked.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least.hint("merge"), "component").select("fp", "component", "component_id")
    return prints.join(named.hint("merge"), "fp").select("row", "doc_id", "fp", "component", "component_id")


def hex_print(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """The document with the smallest id (nulls last) of every component, with all its columns."""
    grouped = near_duplicates(docs.select("doc_id", "text"), bits)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    winners = grouped.groupBy("component").agg(F.min_by("row", order).alias("row")).select("row").distinct()
    packed = docs.select(row_key().alias("row"), F.struct("*").alias("doc"))
    return packed.join(winners.hint("merge"), "row", "left_semi").dropDuplicates(["row"]).select("doc.*")
