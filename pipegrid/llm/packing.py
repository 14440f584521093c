"""Token ids in packed matrices: tokenising, lossless splitting, best-fit-decreasing packing, binary output.

Every document becomes its tokens and an end token. Stretches of a whole row length become rows of their own; what is left
of each document, less than a row, is packed: groups of ``GROUP_ROWS`` rows' worth are sorted by falling length and each
goes to the row with the least room that still holds it. A segment tree over room sizes finds that row. Groups follow the
order of the input, so a mixture keeps its order up to a group.

A packed row has its ids as bytes (little-endian, two bytes each if the vocabulary allows, else four; unused places hold the
end token), its cumulative segment lengths (from 0 to the number of used places), its position resets (where a
segment begins and positions start from 0 again), and for every segment the document and the place in the document's
tokens where the segment begins. Nothing is cut off or dropped: the segments of a document put together are its tokens.

Tasks work on what they read, without a shuffle, and hold one group and one piece of a long text at a time. A null or
empty text is the end token alone. Null and repeated ids are kept as they are. An empty table has no rows.
"""

from __future__ import annotations

import base64
import itertools
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.llm.warc import open_fs
from pipegrid.session import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenising pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50_256  #: free in the vocabulary
ROW = 2_048
GROUP_ROWS = 256
PIECE = 1 << 20  #: characters tokenised together
SCHEMA = "shard int, seq int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, token_starts array<long>, n_tokens int"
SLOTS = "slots array<long>"
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


@lru_cache(2)
def encoder(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in pieces that are tokenised like the whole: cuts lie before a blank between two letters."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def token_ids(text: str | None, vocabulary: str = VOCABULARY) -> Iterator[np.ndarray]:
    """The tokens of a text, a piece at a time, with the end token last."""
    encode = encoder(vocabulary).encode_ordinary
    for piece in pieces(text or ""):
        if piece:
            yield np.array(encode(piece), np.uint32)
    yield np.array([END], np.uint32)


class RoomTree:
    """Segment tree over room sizes 0..row: how many rows have that room; finds the least room that is enough."""

    def __init__(self, row: int):
        self.leaves = 1 << row.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def least(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that some row has."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:  # up to the first right sibling with a row in it, then down its left side
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at *= 2
                    if not self.count[at]:
                        at += 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(lengths: list[int], row: int = ROW) -> list[list[int]]:
    """Rows as lists of item numbers, best fit by falling length; ties keep the order of the input."""
    tree, rows, by_room = RoomTree(row), [], {}
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.least(lengths[item])
        if room is None:
            rows.append([])
            at, room = len(rows) - 1, row
        else:
            at = by_room[room].pop()
            tree.add(room, -1)
        rows[at].append(item)
        left = room - lengths[item]
        by_room.setdefault(left, []).append(at)
        tree.add(left, 1)
    return rows


def _batch(shard: int, first: int, rows: list[list[tuple]], row: int, kind, slots: bool) -> pa.RecordBatch:
    """Rows of (doc_id, start, tokens, slot) segments as an Arrow batch."""
    ids, cumulated, resets, owners, starts, used = [], [], [], [], [], []
    for segments in rows:
        line = np.full(row, END, kind)
        ends = np.cumsum([0, *[len(t) for _, _, t, _ in segments]])
        line[: ends[-1]] = np.concatenate([t for _, _, t, _ in segments])
        ids.append(line.tobytes())
        cumulated.append(ends.tolist())
        resets.append(ends[:-1].tolist())
        owners.append([d for d, _, _, _ in segments])
        starts.append([s for _, s, _, _ in segments])
        used.append(int(ends[-1]))
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard] * n, pa.int32()),
            pa.array(range(first, first + n), pa.int32()),
            pa.array(ids, pa.binary()),
            pa.array(cumulated, pa.list_(pa.int32())),
            pa.array(resets, pa.list_(pa.int32())),
            pa.array(owners, pa.list_(pa.int64())),
            pa.array(starts, pa.list_(pa.int64())),
            pa.array(used, pa.int32()),
            *([pa.array([[p for _, _, _, p in segments] for segments in rows], pa.list_(pa.int64()))] if slots else []),
        ],
        names=[part.split()[0] for part in (f"{SCHEMA}, {SLOTS}" if slots else SCHEMA).split(", ")],
    )


def pack(docs: DataFrame, row: int = ROW, group_rows: int = GROUP_ROWS, vocabulary: str = VOCABULARY, slots: bool = False) -> DataFrame:
    """The packed rows of ``docs`` (doc_id, text); ``shard`` is the task and ``seq`` counts its rows.

    With ``slots``, ``docs`` has a column ``slot`` and rows have those of their segments as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint16 if encoder(vocabulary).max_token_value <= 0xFFFF and END <= 0xFFFF else np.uint32
        shard = TaskContext.get().partitionId()
        seq = 0
        tails: list[tuple] = []
        waiting = 0
        full: list[list[tuple]] = []

        def emit(rows):
            nonlocal seq
            batch = _batch(shard, seq, rows, row, kind, slots)
            seq += len(rows)
            return batch

        def packed():
            return [[tails[i] for i in chosen] for chosen in best_fit([len(t[2]) for t in tails], row)]

        for batch in batches:
            for doc_id, text, slot in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist() if slots else itertools.repeat(None)):
                rest, start = np.zeros(0, np.uint32), 0
                for part in token_ids(text.as_py(), vocabulary):
                    rest = np.concatenate([rest, part]) if len(rest) else part
                    whole = len(rest) // row
                    for k in range(whole):
                        full.append([(doc_id, start + k * row, rest[k * row : (k + 1) * row], slot)])
                        if len(full) == group_rows:
                            yield emit(full)
                            full = []
                    start += whole * row
                    rest = rest[whole * row :]
                if len(rest):
                    tails.append((doc_id, start, rest.copy(), slot))
                    waiting += len(rest)
                if waiting >= group_rows * row:
                    yield emit([*full, *packed()])
                    tails, waiting, full = [], 0, []
        if full:
            yield emit(full)
        if tails:
            yield emit(packed())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(["slot"] if slots else [])).mapInArrow(run, f"{SCHEMA}, {SLOTS}" if slots else SCHEMA)


def write_matrices(packed: DataFrame, folder: str) -> DataFrame:
    """Write packed rows as matrix files; (name, rows) of the files.

    ``name.ids`` holds the id matrix, ``name.seg`` a JSON line per row with its segments. Only named files count: a task
    that was repeated leaves files that no result names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(folder)
        name, rows, ids, segments = uuid.uuid4().hex, 0, None, None
        for batch in batches:
            if ids is None:
                system.create_dir(path, recursive=True)
                ids = system.open_output_stream(f"{path}/{name}.ids")
                segments = system.open_output_stream(f"{path}/{name}.seg")
            for line in batch.to_pylist():
                ids.write(line.pop("ids"))
                segments.write((json.dumps(line) + "\n").encode())
                rows += 1
        if ids is not None:
            ids.close()
            segments.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "rows": [rows]})

    return cut_lineage(packed.mapInArrow(write, "name string, rows long"))


def read_matrix(folder: str, name: str, row: int = ROW, kind=np.uint16) -> tuple[np.ndarray, list[dict]]:
    """One matrix file and its rows' segments."""
    system, path = open_fs(folder)
    with system.open_input_stream(f"{path}/{name}.ids") as ids, system.open_input_stream(f"{path}/{name}.seg") as lines:
        return np.frombuffer(ids.read(), kind).reshape(-1, row), [json.loads(x) for x in lines.read().decode().splitlines()]
