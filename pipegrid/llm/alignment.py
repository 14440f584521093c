"""Alignment of two tokenizers: tokens of both cut into groups at common byte offsets, and token links by overlap.

A document is a space and its text. Each tokenizer's tokens end at byte offsets of it. *Galloping intersection*: the
shorter list of ends drives an exponential and then binary search into the longer one; ends found in both cut the tokens
into groups, and the ranks of a token's two ends give the range of the other side's tokens that it overlaps. A link is a
pair of tokens whose bytes overlap; the count of an id pair is the number of documents that hold it linked.

Texts that are null or empty, or whose tokens of either tokenizer don't join to exactly the space and the text, have no
tokens. Words repeat, so a tokenizer is asked once per task for a stretch between two cuts that neither crosses, and
whole texts are put together from these; stretches start at spaces between words, and only short ones are kept.

Documents are taken in *chunks* of about ``LINKS`` links (a longer document is whole in its own), which are written once to
the shared folder with a dictionary of the chunk's id pairs. Counts over the corpus are sums of the (chunk, pair) rows.
They go back to the chunks by a join on the pair, apart from pairs with a share of the rows that only few can have, which
are broadcast, and meet the chunk's documents in one task per chunk. So neither a frequent pair, a hot source nor a long
document makes a task larger than a chunk or one document. Repeated rows, equal ids and null ids are rows like any other,
each counting as a document. Empty tables give empty tables; only ``doc_id`` and ``text`` are read, so other columns can
have any names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipegrid.llm.common import shared_folder
from pipegrid.session import cut_lineage

VOCABULARIES = "/opt/tokenizers"  #: where the two vocabulary files lie on every machine, an argument of all that use it
LINKS = 1 << 20  #: links after which a chunk is closed
CHARS = 1 << 21  #: characters of documents that are aligned together
KEPT = 1 << 19  #: stretches whose tokens a worker remembers
KEPT_CHARS = 64  #: characters of a stretch that is remembered
HOT = 1 << 16  #: id pairs in more than this part of all (chunk, pair) rows, of which there are fewer than this, are broadcast
ROOM = 1 << 16  #: more than the ids of a vocabulary; an id pair is one number below its square
STRIDE = 16  #: ends that are looked for from the same place

#: A stretch starts at a space that follows something other than white space, and the document starts with a space.
STRETCH = re.compile(r" \s*(?:\S+(?:[^\S ]\s*)?)*")
NO_TOKENS = ""  #: the digest of a document without tokens


def gallop(longer: np.ndarray, targets: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The number of entries of ``longer`` below each target, known to be ``low`` at least.

    Targets step on by 1, 2, 4, ... entries until they are passed, and then halve the last step, all of them at once.
    """
    n, low, high, step = len(longer), low.copy(), low.copy(), 1
    fenced = np.append(longer, np.iinfo(np.int64).max)
    active = np.arange(len(targets))
    while len(active):
        active = active[fenced[high[active]] < targets[active]]
        low[active] = high[active] + 1
        high[active] = np.minimum(high[active] + step, n)
        step *= 2
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        below = fenced[middle] < targets[active]
        low[active[below]] = middle[below] + 1
        high[active[~below]] = middle[~below]
        active = active[low[active] < high[active]]
    return low


def ranks(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """For each end in ``shorter`` (ascending) the number of smaller ends in ``longer``, from the rank of an end before it."""
    if len(shorter) <= STRIDE:
        return gallop(longer, shorter, np.zeros(len(shorter), dtype=np.int64))
    return gallop(longer, shorter, np.repeat(ranks(longer, shorter[::STRIDE]), STRIDE)[: len(shorter)])


class Alignment:
    """Two lists of token ends over the same bytes: which ends they share, and which tokens overlap."""

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray):
        self.swapped = len(ends_a) > len(ends_b)
        shorter, longer = (ends_b, ends_a) if self.swapped else (ends_a, ends_b)
        self.rank = ranks(longer, shorter)
        self.shared = longer[np.minimum(self.rank, len(longer) - 1)] == shorter if len(longer) else np.zeros(0, dtype=bool)
        ours = np.flatnonzero(self.shared)
        theirs = self.rank[ours]
        self.last_a, self.last_b = (theirs, ours) if self.swapped else (ours, theirs)  #: a group's last token on either side

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of all pairs of overlapping tokens: from the rank of a token's start to the rank of its end."""
        if not len(self.rank):
            return self.rank, self.rank
        first = np.concatenate([[0], self.rank[:-1] + self.shared[:-1]])
        many = self.rank - first + 1
        ours = np.repeat(np.arange(len(many)), many)
        theirs = np.arange(len(ours)) + np.repeat(first - (np.cumsum(many) - many), many)
        return (theirs, ours) if self.swapped else (ours, theirs)


class Tokens:
    """The bytes of a vocabulary's tokens, and the ids of stretches of text."""

    def __init__(self, entries: list[bytes]):
        self.bytes = entries
        self.lengths = np.array([len(x) for x in entries], dtype=np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes[i] for i in ids.tolist()])


def byte_letters() -> dict[str, int]:
    """The letter of every byte in byte-level vocabularies: printable ones are themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel(Tokens):
    """Vocabulary A: byte-level pairs, whose words never reach across the start of a stretch."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        before = parts["pre_tokenizer"]
        if parts["normalizer"] or before["type"] != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"]:
            raise ValueError(f"{path}: stretches can't be encoded by themselves")
        letters, entries = byte_letters(), [b""] * self.model.get_vocab_size()
        for entry, i in parts["model"]["vocab"].items():
            entries[i] = bytes(letters[c] for c in entry)
        super().__init__(entries)

    def encode(self, stretches: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(stretches, add_special_tokens=False)]


class Pieces(Tokens):
    """Vocabulary B: pieces, none of which has a space behind something else; a leading space is the model's own."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^\u2581]\u2581", x) for x in pieces):
            raise ValueError(f"{path}: stretches can't be encoded by themselves")
        byte = [re.fullmatch("<0x([0-9A-F]{2})>", x) for x in pieces]
        super().__init__([bytes([int(m[1], 16)]) if m else x.replace("\u2581", " ").encode() for x, m in zip(pieces, byte)])

    def encode(self, stretches: list[str]) -> list[list[int]]:
        # the model puts its space before nothing but the empty text
        alone = [self.model.piece_to_id("\u2581")]
        return [ids or alone for ids in self.model.encode([x[1:] for x in stretches], num_threads=1)]


class Digits:
    """Ids in decimal, each with one of four signs behind it, as fixed rows of characters."""

    SIGNS = (",", "|", ";", "")

    def __init__(self, size: int):
        rows = [f"{i}{sign}".encode() for i in range(size) for sign in self.SIGNS]
        width = max(map(len, rows))
        self.chars = np.frombuffer(b"".join(x.ljust(width) for x in rows), dtype=np.uint8).reshape(-1, width)
        self.lengths = np.array([len(x) for x in rows], dtype=np.int64)

    def text(self, ids: np.ndarray, signs: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The characters of all ids, and where each ends."""
        at = ids * len(self.SIGNS) + signs
        lengths = self.lengths[at]
        return self.chars[at][np.arange(self.chars.shape[1]) < lengths[:, None]].tobytes(), np.cumsum(lengths)


class Pair:
    """Both tokenizers, and what they made of stretches seen before."""

    def __init__(self, folder: str):
        self.a, self.b = ByteLevel(f"{folder}/byte_bpe_50k.json"), Pieces(f"{folder}/piece_bpe_32k.model")
        if max(len(self.a.bytes), len(self.b.bytes)) > ROOM:
            raise ValueError(f"vocabularies of up to {ROOM} ids are asked for")
        self.digits = Digits(max(len(self.a.bytes), len(self.b.bytes)))
        self.kept: dict[str, tuple[bytes, bytes, bool]] = {}

    def learn(self, stretches: set[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        """Ids of both sides as bytes, and whether both join to the stretch."""
        known = self.kept
        new = [x for x in stretches if x not in known]
        made = {}
        for x, a, b in zip(new, self.a.encode(new), self.b.encode(new)):
            a, b, plain = np.array(a, dtype=np.int32), np.array(b, dtype=np.int32), x.encode()
            made[x] = (a.tobytes(), b.tobytes(), self.a.joined(a) == plain == self.b.joined(b))
        if len(known) + len(made) > KEPT:
            made.update((x, known[x]) for x in stretches if x in known)
            known.clear()
        known.update((x, ids) for x, ids in made.items() if len(x) <= KEPT_CHARS)
        return made

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of both sides for each text, none where the text has no tokens."""
        cut = [STRETCH.findall(" " + x) if x else [] for x in texts]
        made = self.learn(set().union(*cut))
        none, out = (np.empty(0, dtype=np.int32),) * 2, []
        for text, stretches in zip(texts, cut):
            found = [self.kept.get(x) or made[x] for x in stretches]
            sides = tuple(np.frombuffer(b"".join(x), dtype=np.int32) for x in list(zip(*found))[:2]) or none
            if not all(x[2] for x in found):
                plain = (" " + text).encode()
                sides = sides if self.a.joined(sides[0]) == plain == self.b.joined(sides[1]) else none
            out.append(sides)
        return out

    def align(self, texts: list[str | None]) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
        """Numbers and digests per text, and its linked id pairs: keys (text's place, then pair) and how often each."""
        sides = self.encode(texts)
        a, b = (np.concatenate([x[k] for x in sides]).astype(np.int64) for k in (0, 1))
        n_a, n_b = (np.array([len(x[k]) for x in sides], dtype=np.int64) for k in (0, 1))
        found = Alignment(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]))
        at_a, at_b = found.links()
        owner = np.repeat(np.arange(len(texts)), n_a)  # of A's tokens; texts end at shared ends
        keys, times = np.unique(owner[at_a] << 32 | a[at_a] * ROOM + b[at_b], return_counts=True)
        numbers = {
            "n_a": n_a.tolist(),
            "n_b": n_b.tolist(),
            "n_groups": np.bincount(owner[found.last_a], minlength=len(texts)).tolist(),
            "n_links": np.bincount(owner[at_a], minlength=len(texts)).tolist(),
            "groups_sha256": self.digest(a, b, n_a, n_b, found),
        }
        return numbers, keys, times

    def digest(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, found: Alignment) -> list[str]:
        """SHA-256 of every text's groups, ``a1,a2|b1;a3|b2,b3``."""
        group_a, group_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        group_a[found.last_a[:-1] + 1] = 1
        group_b[found.last_b[:-1] + 1] = 1
        group_a, group_b = np.cumsum(group_a), np.cumsum(group_b)
        ids, signs = np.empty(len(a) + len(b), dtype=np.int64), np.zeros(len(a) + len(b), dtype=np.int64)
        # in front of a group's tokens of one side are all earlier groups, and for B the group's tokens of A
        place_a = np.arange(len(a)) + (np.concatenate([[0], found.last_b[:-1] + 1])[group_a] if len(a) else 0)
        place_b = np.arange(len(b)) + (found.last_a + 1)[group_b]
        ids[place_a], ids[place_b] = a, b
        signs[place_a[found.last_a]] = 1
        signs[place_b[found.last_b]] = 2
        full = np.cumsum(n_a + n_b)
        signs[full[n_a > 0] - 1] = 3
        chars, ends = self.digits.text(ids, signs)
        stops = np.concatenate([[0], ends])[full].tolist()
        starts = [0, *stops[:-1]]
        return [hashlib.sha256(chars[i:j]).hexdigest() if n else NO_TOKENS for i, j, n in zip(starts, stops, n_a.tolist())]


_PAIRS: dict[str, Pair] = {}


def pair_of(folder: str) -> Pair:
    """A worker's tokenizers, loaded once."""
    if folder not in _PAIRS:
        _PAIRS[folder] = Pair(folder)
    return _PAIRS[folder]


CELLS = "chunk long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, cells binary, times binary, pair long, docs long"
NAMES = [x.split()[0] for x in CELLS.split(", ")]
ARROW = pa.schema(
    [(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in CELLS.split(", "))]
)


def _narrow(values: np.ndarray) -> bytes:
    return values.astype(np.uint32).tobytes()


class Chunk:
    """Documents aligned so far, until they have ``LINKS`` links: rows of kind 0 a document, rows of kind 1 an id pair."""

    def __init__(self, number: int):
        self.number, self.links, self.size = number, 0, 0
        self.rows: dict[str, list] = {n: [] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, ids: list, numbers: dict[str, list], keys: np.ndarray, times: np.ndarray) -> None:
        self.rows["doc_id"].extend(ids)
        for name, values in numbers.items():
            self.rows[name].extend(values)
        self.keys.append(keys + (self.size << 32))
        self.times.append(times)
        self.size += len(ids)
        self.links += sum(numbers["n_links"])

    def batches(self) -> Iterator[pa.RecordBatch]:
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        pairs, places, docs = np.unique(keys & 0xFFFFFFFF, return_inverse=True, return_counts=True)
        stops = np.searchsorted(keys, np.arange(1, self.size + 1) << 32)
        starts = np.concatenate([[0], stops[:-1]])
        cut = lambda x: [_narrow(x[i:j]) for i, j in zip(starts, stops)]
        steps = np.diff(places, prepend=0)
        steps[starts[starts < stops]] = places[starts[starts < stops]]
        yield self.batch(self.size, kind=[0] * self.size, cells=cut(steps), times=cut(times), **self.rows)
        for i in range(0, len(pairs), 1 << 15):
            some = slice(i, i + (1 << 15))
            yield self.batch(len(pairs[some]), kind=[1] * len(pairs[some]), pair=pairs[some], docs=docs[some])

    def batch(self, n: int, **columns) -> pa.RecordBatch:
        columns["chunk"] = [self.number] * n
        return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ARROW], schema=ARROW)


def _aligned(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, first = pair_of(folder), TaskContext.get().partitionId() << 32
        number, chunk = first, Chunk(first)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            i = 0
            while i < len(ids):
                some, size = [], 0
                while i + len(some) < len(ids) and (not some or size < CHARS):
                    some.append(texts[i + len(some)].as_py())
                    size += len(some[-1] or "")
                chunk.add(ids[i : i + len(some)], *pair.align(some))
                i += len(some)
                if chunk.links >= LINKS:
                    yield from chunk.batches()
                    number += 1
                    chunk = Chunk(number)
        if chunk.size:
            yield from chunk.batches()

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _weighed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with the sums over their links."""
    order = np.argsort(counts["pair"].to_numpy())
    count, best = counts["count"].to_numpy()[order], counts["best"].to_numpy()[order]
    n = docs.num_rows
    steps = [np.frombuffer(x, dtype=np.uint32) for x in docs["cells"].to_pylist()]
    times = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in docs["times"].to_pylist()] or [np.empty(0)]).astype(np.int64)
    places = np.concatenate([np.cumsum(x, dtype=np.int64) for x in steps] or [np.empty(0, dtype=np.int64)])
    owner = np.repeat(np.arange(n), [len(x) for x in steps])
    sums = []
    for weight in (best, count):
        total = np.zeros(n, dtype=np.int64)
        np.add.at(total, owner, times * weight[places])
        sums.append(pa.array(total))
    kept = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table({**kept, "n_best": sums[0], "count_sum": sums[1], "groups_sha256": docs["groups_sha256"]})


def aligned_chunks(docs: DataFrame, vocabularies: str = VOCABULARIES) -> tuple[DataFrame, DataFrame]:
    """Documents with their cells, and (chunk, pair, docs) rows, both read from one table in the shared folder."""
    folder = shared_folder(docs.sparkSession)
    cells = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligned(vocabularies), CELLS)
    cells.write.option("compression", "zstd").parquet(folder)
    stored = docs.sparkSession.read.schema(CELLS).parquet(folder)
    held = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "cells", "times"]
    return stored.filter("kind = 0").select(*held), stored.filter("kind = 1").select("chunk", "pair", "docs")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, pair, count, best, chunks): in how many documents an id pair is linked, and if A's id has no higher count."""
    counted = pairs.groupBy("pair").agg(F.sum("docs").alias("count"), F.count("*").alias("chunks"))
    named = counted.withColumn("a", F.expr(f"pair div {ROOM}")).withColumn("b", F.col("pair") % ROOM)
    most = F.max("count").over(W.partitionBy("a"))
    return named.withColumn("best", (F.col("count") == most).cast("long"))


def align(docs: DataFrame, vocabularies: str = VOCABULARIES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    cells, pairs = aligned_chunks(docs, vocabularies)
    counts = cut_lineage(pair_counts(pairs).select("pair", "count", "best", "chunks"))
    # Fewer than HOT pairs can each have more than a HOT-th of all rows: those are broadcast, the others are joined by key.
    limit = pairs.count() // HOT
    hot, rest = counts.filter(F.col("chunks") > limit), counts.filter(F.col("chunks") <= limit)
    frequent = pairs.join(F.broadcast(hot), "pair")
    others = pairs.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(rest, "pair")
    asked = frequent.unionByName(others).select("chunk", "pair", "count", "best")
    cells, asked = (side.toDF(*side.columns).groupBy("chunk") for side in (cells, asked))  # both come from one table
    return cells.cogroup(asked).applyInArrow(_weighed, RESULT)
