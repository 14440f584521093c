"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram vector is the elementwise product of its letters' vectors,
each rotated by its distance from the n-gram's end; a text's vector is the sum of its n-gram vectors. A language's
prototype is the sum of its training texts' unit vectors, less the mean of all prototypes' unit vectors, which every
language shares. The prototype with the largest cosine to the text's vector (less the same mean) is the answer.

Training takes about ``TRAIN_DOCS`` documents per language, drawn by a hash of the id, from whole texts. Prediction
reads whole texts, long ones in pieces whose vectors add up. A null text or one without a letter is ``und`` with score 0,
as is everything when nothing can be learned. A null id counts as not held out. Repeated rows have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 512
GRAM = 3
CLASSES = 1024  #: letters below 768 stand for themselves, others share 255 classes; 0 is all that is no letter
SEED = 42
TRAIN_DOCS = 2_000
PIECE = 1 << 18  #: characters that are worked on together
UNKNOWN = "und"


@lru_cache(1)
def _classes() -> np.ndarray:
    """The letter class of every code point."""
    points = np.arange(0x110000)
    kinds = np.where(points < 768, points, 768 + points * 2654435761 % 255)
    kinds[~np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)] = 0
    return kinds.astype(np.int32)


@lru_cache(1)
def _letters() -> list[np.ndarray]:
    """Letter vectors rotated by 0, 1, ... places."""
    base = np.random.default_rng(SEED).integers(0, 2, (CLASSES, DIM), np.int8) * 2 - 1
    return [np.roll(base, k, axis=1) for k in range(GRAM)]


def _profiles(pieces: list[str]) -> np.ndarray:
    """The vectors of some short texts."""
    lengths = np.array([len(p) + GRAM - 1 for p in pieces])
    gap = " " * (GRAM - 1)
    joined = gap + gap.join(pieces) + gap
    kinds = _classes()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    owner = np.repeat(np.arange(len(pieces)), lengths)
    grams = np.zeros(len(owner), np.int64)
    some = np.zeros(len(owner), bool)
    for k in range(GRAM):
        part = kinds[k : k + len(owner)]
        grams = grams * CLASSES + part
        some |= part > 0
    ids, slots = np.unique(grams[some], return_inverse=True)
    counts = np.bincount(owner[some] * len(ids) + slots, minlength=len(pieces) * len(ids)).reshape(len(pieces), len(ids)).astype(np.float32)
    out = np.zeros((len(pieces), DIM), np.float32)
    for start in range(0, len(ids), 1 << 13):
        part = ids[start : start + (1 << 13)]
        bound = np.ones((len(part), DIM), np.int8)
        for k, rotated in enumerate(_letters()):
            bound *= rotated[part // CLASSES**k % CLASSES]
        out += counts[:, start : start + (1 << 13)] @ bound.astype(np.float32)
    return out


def profiles(texts: list[str | None]) -> np.ndarray:
    """One vector per text; the zero vector without letters."""
    out = np.zeros((len(texts), DIM), np.float64)
    batch: list[tuple[int, str]] = []
    size = 0

    def flush():
        if batch:
            np.add.at(out, [i for i, _ in batch], _profiles([p for _, p in batch]))
        batch.clear()

    for i, text in enumerate(texts):
        text = (text or "").lower()
        for start in range(0, len(text), PIECE):
            piece = text[start : start + PIECE]
            if size + len(piece) > PIECE:
                flush()
                size = 0
            batch.append((i, piece))
            size += len(piece)
    flush()
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """The languages and their prototypes, from rows that are not held out and have a language.

    Tasks add up unit vectors; a row per language and slot is all that is shuffled and collected.
    """
    usable = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null").filter(~held_out())
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, DIM))
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    chance = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    drawn = usable.filter(chance < F.element_at(rate, F.col("lang")))

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            vectors = _unit(profiles(list(frame["text"])))
            for lang, rows in frame.groupby("lang").indices.items():
                sums[lang] = sums.get(lang, 0) + vectors[rows].sum(axis=0)
        for lang, total in sums.items():
            yield pd.DataFrame({"lang": lang, "slot": np.arange(DIM), "value": total})

    parts = drawn.select("lang", "text").mapInPandas(add, "lang string, slot int, value double")
    rows = parts.groupBy("lang", "slot").agg(F.sum("value").alias("value"))
    sums: dict[str, np.ndarray] = {}
    for row in rows.collect():
        sums.setdefault(row.lang, np.zeros(DIM))[row.slot] = row.value
    names = sorted(sums)
    return names, np.array([sums[n] for n in names])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    names, sums = model
    unit = _unit(sums)
    mean = unit.mean(axis=0) if len(names) > 1 else np.zeros(DIM)
    centred = _unit(unit - mean)
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(schema)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            vectors = profiles(list(texts))
            blank = ~vectors.any(axis=1)
            cosines = _unit(_unit(vectors) - mean) @ centred.T if names else np.zeros((len(vectors), 1))
            best = cosines.argmax(axis=1)
            pred = np.array([*names, UNKNOWN], object)[best]
            pred[blank] = UNKNOWN
            score = np.clip((1 + cosines.max(axis=1)) / 2, 0, 1)
            yield pd.DataFrame({"lang_pred": pred, "score": np.where(pred == UNKNOWN, 0.0, score)})

    scored = docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score")
