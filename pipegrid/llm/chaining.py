"""Repeated passages across documents by collinear chaining of shared word k-mers.

Seeds are all k-mers of ``K`` words: of forty words or more with four fifths equal in place, five runs of K at least stay whole,
so that near passages have common seeds whatever words are changed. A seed that occurs in several documents has a
representative, the one with the smallest id; every other document is matched with it, not with all others, so a passage that
thousands share yields as many links as documents. Since small ids that hold only parts of a passage would take its short
seeds, longer runs (``RUNS``) are seeds as well, thinned to minimizers (of every so many consecutive runs the one with the least
hash), and have representatives of their own: documents with a common run of 51 words share one of 40, whose representative
has these 40 words. A match of a run counts as one of its first and one of its last K words.

Tasks put their seeds into buckets by hash, as blocks of bytes; a bucket holds a bounded share of the input and is matched by
sorting. A seed that lies in both documents in many ways is sent as lists of its places, which are paired all with all where
they are chained. The matches of a document with one representative are chained: ordered in both, each
adding its words less a cost for the gap, the best predecessor found by a Fenwick tree over positions in the representative.
Chains are aligned word by word: along the diagonal where both gaps are equal, by edit distance inside other gaps, and
outwards at both ends. A passage counts from ``MIN_WORDS`` words and an identity of ``IDENTITY``; a chain below that is cut at
its gaps, and its parts are judged each on its own.

Words are letters, digits and underscores in lower case. A document without an id can't be named and is left out, as is one
of fewer than K words. Rows with equal ids count as one document: their texts' matches are taken together, repeated rows once.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.session import cut_lineage

K = 4
SPAN = 1
RUNS = ((K, SPAN), (12, 12), (24, 12), (40, 12))  #: words of each kind of seed, and among how many one is taken
BUCKET_CHARS = 1 << 22  #: characters of input for each bucket of seeds
LEAST_BUCKETS = 48
HASH_BYTES = 6  #: of a seed's hash beyond what its bucket says; alignment compares the words
FLUSH = 1 << 21  #: seeds that a task holds
WORDS_HELD = 1 << 18  #: words of texts whose seeds are found together
MEETINGS = 64  #: up to so many ways for a seed to lie in a document and its representative the pairs are sent, else the places
PAIRS_HELD = 1 << 18  #: position pairs that are chained together where places were sent
OVERLAP = 256  #: words, more than a passage of MIN_WORDS needs with its margins
GAP_COST = 0.1  #: per word that a gap is long in either document
MIN_WORDS = 40
IDENTITY = 0.8
MARGIN = 24  #: words beyond a chain's ends that alignment may take in
WORD_BITS = 1 << 11  #: values by which words are compared before they are aligned
PARTS = 1_000  #: stretches of a chain among which the longest passing part is searched
SALTS = 32
_WORDS = re.compile(r"\w+")
_SPACED = bytes(ord(c.lower()) if _WORDS.match(c) else 32 for c in map(chr, range(128))) + bytes(128)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PRIMES = [np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]  # of XXH64


def words_of(text: str) -> list[str]:
    """The matches of ``_WORDS`` in a text in lower case; to split at spaces is faster than to search."""
    if text.isascii():
        return text.encode().translate(_SPACED).decode().split()
    text = text.lower()
    for c in set(text):
        if not c.isalnum() and c != "_":
            text = text.replace(c, " ")
    return text.split()


def _turned(values: np.ndarray, bits: int) -> np.ndarray:
    return values << np.uint64(bits) | values >> np.uint64(64 - bits)


def hashes_of(words: list[str]) -> np.ndarray:
    """XXH64 of words without spaces, in UTF-8; all of fewer than 32 bytes together, the others one by one."""
    if not words:
        return np.zeros(0, np.uint64)
    text = " ".join(words).encode("utf-8", "replace")
    padded = text + bytes(8)
    one = np.frombuffer(padded, np.uint8)
    four, eight = (np.ndarray(len(text), kind, padded, strides=(1,)) for kind in ("<u4", "<u8"))  # from every byte on
    end = np.append(np.flatnonzero(one[: len(text)] == 32), len(text))
    at = np.append(0, end[:-1] + 1)
    left = end - at
    out = left.astype(np.uint64) + _PRIMES[4]
    for i in np.flatnonzero(left >= 32).tolist():
        out[i], left[i] = xxhash.xxh64_intdigest(text[at[i] : end[i]]), -1
    done = left < 0
    while len(some := np.flatnonzero(left >= 8)):
        lane = _turned(eight[at[some]] * _PRIMES[1], 31) * _PRIMES[0]
        out[some] = _turned(out[some] ^ lane, 27) * _PRIMES[0] + _PRIMES[3]
        at[some] += 8
        left[some] -= 8
    if len(some := np.flatnonzero(left >= 4)):
        out[some] = _turned(out[some] ^ four[at[some]].astype(np.uint64) * _PRIMES[0], 23) * _PRIMES[1] + _PRIMES[2]
        at[some] += 4
        left[some] -= 4
    while len(some := np.flatnonzero(left > 0)):
        out[some] = _turned(out[some] ^ one[at[some]].astype(np.uint64) * _PRIMES[4], 11) * _PRIMES[0]
        at[some] += 1
        left[some] -= 1
    last = out ^ out >> np.uint64(33)
    last *= _PRIMES[1]
    last ^= last >> np.uint64(29)
    last *= _PRIMES[2]
    last ^= last >> np.uint64(32)
    return np.where(done, out, last)


def _polynomials(words: np.ndarray, k: int) -> np.ndarray:
    """Of every k consecutive words a polynomial in _ODD, put together from those of 1, 2, 4, ... words."""
    out, done, part, width = None, 0, words, 1
    while True:
        factor = np.uint64(pow(int(_ODD), width, 1 << 64))
        if k & width:
            n = len(words) - done - width + 1
            out = part[:n].copy() if out is None else out[:n] * factor + part[done : done + n]
            done += width
        if done == k:
            return out
        part = part[:-width] * factor + part[width:]
        width *= 2


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The first place of the least value among every ``span`` consecutive ones."""
    at, least, width = np.arange(len(values)), values, 1
    while width < span:
        on = min(width, span - width)
        left = least[:-on] <= least[on:]
        at, least = np.where(left, at[:-on], at[on:]), np.where(left, least[:-on], least[on:])
        width += on
    return at


def minimizers(words: np.ndarray, k: int = K, span: int = SPAN, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of the seeds; of texts behind each other with ``lengths``, none reaches from one to the next."""
    if span > k:
        raise ValueError("the window of a short text would reach into the next")
    lengths = np.array([len(words)]) if lengths is None else lengths
    total = len(words)
    if total < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.full(total + span, np.iinfo(np.uint64).max)  # where a text ends, the largest value takes their place
    whole = _polynomials(words, k)
    whole ^= whole >> np.uint64(29)
    whole *= _ODD
    whole ^= whole >> np.uint64(32)
    begin = np.cumsum(lengths) - lengths
    usable = np.arange(len(whole)) <= np.repeat(begin + lengths - k, lengths)[: len(whole)]
    grams[: len(whole)][usable] = whole[usable]
    if span > 1:
        last = np.where(lengths >= k, begin + np.maximum(lengths - k + 1 - span, 0), -1)
        heads = np.flatnonzero(np.arange(total) <= np.repeat(last, lengths))
        chosen = []
        for first in range(0, total, 1 << 16):  # in stretches, so that memory stays bounded
            part = grams[first : min(total, first + (1 << 16)) + span - 1]
            least = _least(part, span)
            here = heads[np.searchsorted(heads, first) : np.searchsorted(heads, first + (1 << 16))]
            chosen.append(first + least[here - first])
        taken = np.zeros(total, bool)
        taken[np.concatenate(chosen)] = True
        at = np.flatnonzero(taken)
    else:
        at = np.flatnonzero(usable)
    text = np.repeat(np.arange(len(lengths)), lengths)[at]
    keep = np.append(True, (grams[at[1:]] != grams[at[:-1]]) | (text[1:] != text[:-1]))[: len(at)]  # of a word repeated on and on, the first
    return grams[at][keep].view(np.int64), at[keep]


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, those of equal weight together."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)[:, :width].T.tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view(np.uint64).ravel()


def _packed(ids: np.ndarray, hashes: np.ndarray, places: np.ndarray, hash_bytes: int) -> tuple[int, int, bytes]:
    """Numbers of seeds and of stretches with one id, and both with their places: bytes of equal weight together, compressed."""
    heads = np.flatnonzero(np.append(True, np.diff(ids) != 0))
    counts = np.diff(np.append(heads, len(ids))).astype(np.uint32)
    data = _planes(np.diff(ids[heads], prepend=np.int64(0)), 8) + _planes(counts, 4) + _planes(places, 4) + _planes(hashes, hash_bytes)
    return len(ids), len(heads), pa.compress(data, "zstd", asbytes=True)


def _unpacked(n: int, heads: int, data: bytes, hash_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, hashes, places) as they were packed."""
    widths = [8 * heads, 4 * heads, 4 * n, hash_bytes * n]
    data = pa.decompress(data, sum(widths), "zstd", asbytes=True)
    ids, counts, places, hashes = (data[end - width : end] for width, end in zip(widths, np.cumsum(widths)))
    ids = np.repeat(np.cumsum(_numbers(ids, 8).view(np.int64)), _numbers(counts, 4).astype(np.int64))
    return ids, _numbers(hashes, hash_bytes), _numbers(places, 4)


def seeds(docs: DataFrame, buckets: int, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """(bucket, n, heads, seeds) of every document with an id: blocks of seeds, document after document.

    Places are word positions times len(RUNS) plus the kind of seed.
    """

    def found(texts: list[tuple[int, list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, hashes and places of the seeds of some texts."""
        lengths = np.array([len(w) for _, w in texts])
        words, begin = hashes_of(list(itertools.chain.from_iterable(w for _, w in texts))), np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(texts), dtype=np.uint16 if len(texts) < 1 << 16 else np.int64), lengths)
        hashes, places, owners = [], [], []
        for kind, (k, span) in enumerate(RUNS):
            some, at = minimizers(words, k, span, lengths)
            mine = owner[at]
            hashes.append(some.view(np.uint64))
            places.append(((at - begin[mine]) * len(RUNS) + kind).astype(np.uint32))
            owners.append(mine)
        mine = np.concatenate(owners)
        order = np.argsort(mine, kind="stable")
        return np.array([d for d, _ in texts], np.int64)[mine[order]], np.concatenate(hashes)[order], np.concatenate(places)[order]

    def block(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        ids, hashes, places = (np.concatenate(x) for x in zip(*rows))
        bucket = (hashes % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
        hashes = hashes // np.uint64(buckets)  # the bucket has the rest
        order = np.argsort(bucket, kind="stable")
        bucket, ids, hashes, places = bucket[order], ids[order], hashes[order], places[order]
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
        out = [(int(bucket[at]), *_packed(ids[at:end], hashes[at:end], places[at:end], hash_bytes)) for at, end in zip(starts, [*starts[1:], len(bucket)])]
        return pd.DataFrame(out, columns=["bucket", "n", "heads", "seeds"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, words, rows, held = [], 0, [], 0
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                texts.append((doc_id, words_of(text)))
                words += len(texts[-1][1])
                if words >= WORDS_HELD:
                    rows.append(found(texts))
                    held += len(rows[-1][0])
                    texts, words = [], 0
                if held >= FLUSH:
                    yield block(rows)
                    rows, held = [], 0
        if texts:
            rows.append(found(texts))
        if rows:
            yield block(rows)

    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return usable.mapInPandas(run, "bucket int, n int, heads int, seeds binary")


def _met(hashes: np.ndarray, ids: np.ndarray, places: np.ndarray) -> pd.DataFrame:
    """Positions of shared seeds in documents and their representatives; a position pair is one number.

    Seeds are the same if hash and kind are: runs of different length never meet. Of a seed that lies in both in more than
    ``MEETINGS`` ways the places on either side are listed (see :func:`_listed`), so that rows grow with their sum.
    """
    hashes = hashes.astype(np.uint64) * np.uint64(len(RUNS)) + places.astype(np.uint64) % np.uint64(len(RUNS))
    order = np.argsort(hashes)
    sorted_ = hashes[order]
    same = sorted_[1:] == sorted_[:-1]
    order = order[np.append(False, same) | np.append(same, False)] if len(order) else order  # a seed alone meets nothing
    hashes, ids, places = hashes[order], ids[order], places[order]
    order = np.lexsort((places, ids, hashes))
    hashes, ids, places = hashes[order], ids[order], places[order].astype(np.int64)
    group = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    size = np.diff(np.append(group, len(hashes)))
    start = np.repeat(group, size)
    away = np.flatnonzero(ids != ids[start])
    homes = np.repeat(np.add.reduceat(ids == ids[start], group), size) if len(group) else size
    # how often the seed lies in the document, and which of these places an entry is
    own = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (ids[1:] != ids[:-1]))) if len(hashes) else group
    often = np.diff(np.append(own, len(hashes)))
    nth = np.arange(len(hashes)) - np.repeat(own, often)
    often = np.repeat(often, often)
    r, d, e = homes[away], often[away], nth[away]
    every = r * d <= MEETINGS
    # pairs; else the document's places, each once, and with the first of them the representative's
    once = np.where(every, r, np.where(e == 0, r, 0))
    row = np.repeat(np.arange(len(away)), once)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(once) - once, once)
    home = start[away][row] + turn
    at, rep_at, kind = places[away][row] // len(RUNS), places[home] // len(RUNS), places[home] % len(RUNS)
    more = np.array([k for k, _ in RUNS])[kind] - K
    doc, rep, paired, tag = ids[away][row], ids[home], every[row], hashes[home]
    lone = np.flatnonzero(~every)
    lone_at, lone_kind = places[away][lone] // len(RUNS), places[away][lone] % len(RUNS)
    lone_more = np.array([k for k, _ in RUNS])[lone_kind] - K
    out = []
    for end in (0, 1):  # a run's first and last words
        some = slice(None) if end == 0 else np.flatnonzero(more)
        pair = np.where(paired, (at + end * more) << 32 | (rep_at + end * more), _listed(1, tag, end, rep_at + end * more))
        out.append((doc[some], rep[some], pair[some]))
        some = slice(None) if end == 0 else np.flatnonzero(lone_more)
        listed = _listed(0, hashes[away][lone], end, lone_at + end * lone_more)
        out.append((ids[away][lone][some], ids[start[away][lone]][some], listed[some]))
    return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("doc_id", "rep", "pair"), zip(*out))})


def _listed(side: int, seeds_of: np.ndarray, end: int, at: np.ndarray) -> np.ndarray:
    """One place of a seed in the document (side 0) or its representative (side 1) as a number below zero."""
    tags = (seeds_of * _ODD >> np.uint64(32)).astype(np.int64) ^ (end * 0x5BD1E995)
    return ~((side << 62) | (tags << 30) | at)


def _packed_matches(met: pd.DataFrame, parts: int) -> pd.DataFrame:
    """(part, n, heads, matches): matches by a hash of both documents, those of the same two together, as compressed bytes."""
    docs, reps, pairs = (met[c].to_numpy().astype(np.int64) for c in ("doc_id", "rep", "pair"))
    mixed = (docs.view(np.uint64) * _ODD + reps.view(np.uint64)) * _ODD
    part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((pairs, reps, docs, part))
    part, docs, reps, pairs = part[order], docs[order], reps[order], pairs[order]
    out = []
    for at, end in zip(starts := np.flatnonzero(np.diff(part, prepend=-1)), [*starts[1:], len(part)]):
        d, r = docs[at:end], reps[at:end]
        heads = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1])))
        counts = np.diff(np.append(heads, len(d))).astype(np.uint32)
        own = pairs[at:end].view(np.uint64)
        place = (own >> np.uint64(32)).astype(np.uint32)
        shift = own.astype(np.uint32) - place  # the same as long as matches follow each other
        data = b"".join([*(_planes(np.diff(x[heads], prepend=np.int64(0)), 8) for x in (d, r)), _planes(counts, 4), _planes(place, 4), _planes(np.diff(shift, prepend=np.uint32(0)), 4)])
        out.append((int(part[at]), len(d), len(heads), pa.compress(data, "zstd", asbytes=True)))
    return pd.DataFrame(out, columns=["part", "n", "heads", "matches"])


def _unpacked_matches(n: int, heads: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, rep, pair) as they were packed."""
    widths = [8 * heads, 8 * heads, 4 * heads, 4 * n, 4 * n]
    data = pa.decompress(data, sum(widths), "zstd", asbytes=True)
    docs, reps, counts, place, shift = (_numbers(data[end - width : end], 8 if i < 2 else 4) for i, (width, end) in enumerate(zip(widths, np.cumsum(widths))))
    counts = counts.astype(np.int64)
    low = (np.cumsum(shift.astype(np.uint32), dtype=np.uint32) + place.astype(np.uint32)).astype(np.uint64)
    docs, reps = (np.repeat(np.cumsum(x.view(np.int64)), counts) for x in (docs, reps))
    return docs, reps, (place << np.uint64(32) | low).view(np.int64)


def matches(found: DataFrame, parts: int, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """(part, n, heads, matches): positions of shared seeds in documents and their representatives, all of two documents in one part."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        blocks = [_unpacked(*row, hash_bytes) for row in zip(frame["n"], frame["heads"], frame["seeds"])]
        ids, hashes, places = (np.concatenate(x) for x in zip(*blocks))
        return _packed_matches(_met(hashes, ids, places), parts)

    return found.groupBy("bucket").applyInPandas(meet, "part int, n int, heads int, matches binary")


def thinned_groups(group: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, at, rep_at), by group: pairs of which every K-th is kept, and the last, where they follow each other word by word."""
    at, rep_at = pairs >> 32, pairs & 0xFFFFFFFF
    order = np.lexsort((at, at - rep_at, group))
    group, at, rep_at = group[order], at[order], rep_at[order]
    other = np.diff(group) != 0
    once = np.append(True, other | (np.diff(at) != 0) | (np.diff(rep_at) != 0))[: len(at)]
    group, at, rep_at = group[once], at[once], rep_at[once]
    fresh = np.append(True, (np.diff(group) != 0) | (np.diff(at) != 1) | (np.diff(rep_at) != 1))[: len(at)]
    heads = np.flatnonzero(fresh)
    nth = np.arange(len(at)) - heads[np.cumsum(fresh) - 1]
    keep = (nth % K == 0) | np.append(fresh[1:], True)[: len(at)]
    return group[keep], at[keep], rep_at[keep]


def thinned(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Position pairs of one group as :func:`thinned_groups` keeps them."""
    _, at, rep_at = thinned_groups(np.zeros(len(pairs), np.int64), pairs)
    return list(zip(at.tolist(), rep_at.tolist()))


class Peaks:
    """Fenwick tree of prefix maxima with the item that holds each."""

    def __init__(self, size: int):
        self.best = [(-1e18, -1)] * (size + 1)

    def put(self, at: int, value: float, item: int) -> None:
        at += 1
        while at < len(self.best):
            if self.best[at][0] < value:
                self.best[at] = (value, item)
            at += at & -at

    def before(self, at: int) -> tuple[float, int]:
        """The largest value at places below ``at``."""
        found = (-1e18, -1)
        while at:
            if self.best[at][0] > found[0]:
                found = self.best[at]
            at -= at & -at
        return found


def chains(pairs: list[tuple[int, int]], k: int = K, cost: float = GAP_COST) -> list[list[tuple[int, int]]]:
    """Disjoint chains of matches, best first; each is ordered in both positions."""
    pairs = sorted(set(pairs))
    score, link = [0.0] * len(pairs), [-1] * len(pairs)
    first = 0
    if all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs)):
        # ordered in both, the last match before is always the best
        value = -1e18
        for i, (a, b) in enumerate(pairs):
            gain = value - cost * (a + b)
            score[i], link[i] = (gain + k, i - 1) if gain > 0 else (k, -1)
            value = score[i] + cost * (a + b)
        first = len(pairs)
    ranks = {p: i for i, p in enumerate(sorted({b for _, b in pairs[first:]}))}
    tree = Peaks(len(ranks))
    while first < len(pairs):
        last = first
        while last < len(pairs) and pairs[last][0] == pairs[first][0]:
            a, b = pairs[last]
            value, item = tree.before(ranks[b])
            gain = value - cost * (a + b)
            if item >= 0 and gain > 0:
                score[last], link[last] = gain + k, item
            else:
                score[last] = k
            last += 1
        for i in range(first, last):  # a match may not follow one at the same position
            a, b = pairs[i]
            tree.put(ranks[b], score[i] + cost * (a + b), i)
        first = last
    used = [False] * len(pairs)
    out = []
    for end in sorted(range(len(pairs)), key=lambda i: -score[i]):
        chain, at = [], end
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(pairs[at])
            at = link[at]
        if len(chain) > 1:
            out.append(chain[::-1])
    return out


def _product(doc: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """All position pairs of the seeds that both sides list; rows are (tag, place), ordered by tag."""
    tags, first, often = np.unique(rep[:, 0], return_index=True, return_counts=True)
    if not len(tags):
        return np.zeros(0, np.int64)
    which = np.minimum(np.searchsorted(tags, doc[:, 0]), len(tags) - 1)
    times = np.where(tags[which] == doc[:, 0], often[which], 0)
    row = np.repeat(np.arange(len(doc)), times)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return doc[row, 1] << 32 | rep[first[which[row]] + turn, 1]


def _in_turn(doc: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Every listed place paired once, the n-th of a seed with the n-th, from the first again where one side has fewer."""
    out = [np.zeros(0, np.int64)]
    for tag in np.intersect1d(doc[:, 0], rep[:, 0]):
        ours, theirs = (x[np.searchsorted(x[:, 0], tag) : np.searchsorted(x[:, 0], tag, "right"), 1] for x in (doc, rep))
        turn = np.arange(len(ours) * -(-len(theirs) // len(ours)))
        out.append(ours[turn % len(ours)] << 32 | theirs[turn % len(theirs)])
    return np.concatenate(out)


class Covered:
    """Stretches of a document that are known to be passages, none inside another."""

    def __init__(self):
        self.first: list[int] = []
        self.end: list[int] = []

    def has(self, first: int, end: int) -> bool:
        at = bisect.bisect_right(self.first, first) - 1
        return at >= 0 and self.end[at] >= end

    def add(self, first: int, end: int) -> None:
        at = bisect.bisect_left(self.first, first)
        while at < len(self.first) and self.end[at] <= end:
            del self.first[at], self.end[at]
        self.first.insert(at, first)
        self.end.insert(at, end)


def _is_passage(chain: list[tuple[int, int]]) -> bool:
    """Whether a chain's seeds alone have the length and the identity."""
    same = K + sum(min(K, y[0] - x[0], y[1] - x[1]) for x, y in itertools.pairwise(chain))
    return _counts(chain[0][0], chain[-1][0] + K, chain[0][1], chain[-1][1] + K, same)


def all_chains(pairs: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """Chains of a document's matches with one representative, listed places included.

    Listed places are paired in turn first, then all with all, in squares of both texts that hold ``PAIRS_HELD`` pairs or are
    ``2 * OVERLAP`` words wide and that overlap, so that a passage lies in one. A chain of these is left out if its words in
    the document are inside a passage found before: it would say once more that the representative has these words.
    """
    plain, listed = pairs[pairs >= 0], ~pairs[pairs < 0]
    if not len(listed):
        yield from chains(thinned(plain))
        return
    sides = []
    for side in (0, 1):
        some = listed[listed >> 62 == side]
        sides.append(np.unique(np.stack([some >> 30 & 0xFFFFFFFF, some & 0x3FFFFFFF], axis=1), axis=0))
    covered, seen = Covered(), set()

    def fresh(some: np.ndarray, again: bool = True) -> Iterator[list[tuple[int, int]]]:
        for chain in chains(thinned(some)):
            first, end = chain[0][0], chain[-1][0] + K
            inside = covered.has(first, end)
            if again and (inside or (chain[0], chain[-1]) in seen):
                continue
            seen.add((chain[0], chain[-1]))
            if not inside and _is_passage(chain):
                covered.add(first, end)
            yield chain

    yield from fresh(np.concatenate([plain, _in_turn(*sides)]), again=False)
    tops = [max((int(x[:, 1].max()) if len(x) else 0, int(y.max()) if len(y) else 0)) + 1 for x, y in zip(sides, (plain >> 32, plain & 0xFFFFFFFF))]
    open_squares = [((0, tops[0]), (0, tops[1]), plain, *sides)]
    while open_squares:
        across, down, some, doc, rep = open_squares.pop()
        tags, often = np.unique(rep[:, 0], return_counts=True)
        both = doc[np.isin(doc[:, 0], tags)]
        if not len(both):
            continue  # only pairs that were chained before
        places = np.append(both[:, 1], some >> 32)
        if covered.has(int(places.min()), int(places.max()) + K):
            continue
        held = len(some) + int(often[np.searchsorted(tags, both[:, 0])].sum())
        widths = across[1] - across[0], down[1] - down[0]
        if held <= PAIRS_HELD or max(widths) <= 2 * OVERLAP:
            yield from fresh(np.concatenate([some, _product(both, rep)]))
            continue
        middle = [(x + y) // 2 for x, y in (across, down)]
        for late in (1, 0):  # the last one put is taken first
            if widths[0] >= widths[1]:
                low, high = (middle[0] - OVERLAP // 2, across[1]) if late else (across[0], middle[0] + OVERLAP // 2)
                inside = (some >> 32 >= low) & (some >> 32 < high)
                open_squares.append(((low, high), down, some[inside], both[(both[:, 1] >= low) & (both[:, 1] < high)], rep))
            else:
                low, high = (middle[1] - OVERLAP // 2, down[1]) if late else (down[0], middle[1] + OVERLAP // 2)
                inside = (some & 0xFFFFFFFF >= low) & (some & 0xFFFFFFFF < high)
                open_squares.append((across, (low, high), some[inside], both, rep[(rep[:, 1] >= low) & (rep[:, 1] < high)]))


def chained(met: DataFrame) -> DataFrame:
    """(chain, doc_id, rep, at, rep_at): chains that may hold a passage."""

    def groups(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, Iterator[list[tuple[int, int]]]]]:
        """The chains of two documents with more than one match."""
        rows = itertools.chain.from_iterable(zip(f["part"], f["n"], f["heads"], f["matches"]) for f in frames)
        for _, part in itertools.groupby(rows, lambda row: row[0]):
            docs, reps, pairs = (np.concatenate(x) for x in zip(*(_unpacked_matches(*row[1:]) for row in part)))
            order = np.lexsort((reps, docs))
            docs, reps, pairs = docs[order], reps[order], pairs[order]
            heads = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (reps[1:] != reps[:-1])))
            sizes = np.diff(np.append(heads, len(docs)))
            plain = (np.minimum.reduceat(pairs, heads) >= 0) & (sizes > 1)
            group = np.repeat(np.arange(len(heads)), sizes)
            mine = np.repeat(plain, sizes)
            group, at, rep_at = thinned_groups(group[mine], pairs[mine])
            begin, end = (np.searchsorted(group, np.arange(len(heads)), side).tolist() for side in ("left", "right"))
            at, rep_at = at.tolist(), rep_at.tolist()
            for i in np.flatnonzero(sizes > 1).tolist():
                own = slice(begin[i], end[i])
                found = chains(list(zip(at[own], rep_at[own]))) if plain[i] else all_chains(pairs[heads[i] : heads[i] + sizes[i]])
                yield int(docs[heads[i]]), int(reps[heads[i]]), found

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["chain", "doc_id", "rep", "at", "rep_at"]
        rows, held = [], 0
        for doc_id, rep, found in groups(frames):
            for chain in found:
                if chain[-1][0] - chain[0][0] + K + 2 * MARGIN >= MIN_WORDS:
                    name = xxhash.xxh64_intdigest(f"{doc_id}:{rep}:{chain[0]}:{chain[-1]}") - (1 << 63)
                    rows.append((name, doc_id, rep, [a for a, _ in chain], [b for _, b in chain]))
                    held += len(chain)
                    if held >= 1 << 17:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)

    together = met.repartition("part").sortWithinPartitions("part")
    return cut_lineage(together.mapInPandas(run, "chain long, doc_id long, rep long, at array<int>, rep_at array<int>"), free_shuffles=True)


def _stretches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(chain, side, start, words): the word hashes of both sides of each chain, with margins.

    Of a representative that many chains name, ``SALTS`` rows at most meet its text.
    """
    sides = found.select("chain", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("doc_id").alias("doc_id"), F.col("at").alias("at")), F.struct(F.lit(1).alias("side"), F.col("rep").alias("doc_id"), F.col("rep_at").alias("at")))).alias("s"))
    salt = F.when(F.col("s.side") == 1, F.pmod("chain", F.lit(SALTS))).otherwise(0)  # a document's own chains are bounded by its words
    spans = sides.select("s.doc_id", salt.alias("salt"), F.struct("chain", "s.side", F.element_at("s.at", 1).alias("first"), F.element_at("s.at", -1).alias("last")).alias("span"))
    wanted = spans.groupBy("doc_id", "salt").agg(F.collect_list("span").alias("spans")).select("doc_id", "spans")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")

    def stretches(texts: list[list[str]], owner: list[int], spans: pa.StructArray) -> Iterator[pa.RecordBatch]:
        """The words of some spans, each in the text that it belongs to."""
        chain, side, first, end = (spans.field(c).to_numpy() for c in ("chain", "side", "first", "last"))
        lengths = np.array([len(t) for t in texts])
        words = (hashes_of(list(itertools.chain.from_iterable(texts))) & np.uint64(0x7FFFFFFF)).astype(np.int32)
        begin = (np.cumsum(lengths) - lengths)[owner]
        start = np.maximum(first - MARGIN, 0)
        size = np.maximum(np.minimum(end + K + MARGIN, lengths[owner]) - start, 0)
        portion = (np.cumsum(size) - size) // FLUSH
        for own in np.split(np.arange(len(size)), np.flatnonzero(np.diff(portion)) + 1):
            offsets = np.append(0, np.cumsum(size[own]))
            places = np.arange(offsets[-1]) + np.repeat(begin[own] + start[own] - offsets[:-1], size[own])
            listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(words[places]))
            yield pa.RecordBatch.from_arrays([pa.array(chain[own]), pa.array(side[own]), pa.array(start[own]), listed], names=["chain", "side", "start", "words"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts = batch.column("spans").flatten(), pc.list_value_length(batch.column("spans")).to_numpy()
            ends = np.append(0, np.cumsum(counts))
            texts, owner, words, last, first = [], [], 0, None, 0
            for row, text in enumerate(batch.column("text")):
                text = text.as_py()
                if text != last or not texts:
                    last = text
                    texts.append(words_of(text))
                    words += len(texts[-1])
                owner.append(len(texts) - 1)
                if words >= WORDS_HELD or row + 1 == len(counts):
                    yield from stretches(texts, np.repeat(owner, counts[first : row + 1]), values[ends[first] : ends[row + 1]])
                    texts, owner, words, first = [], [], 0, row + 1

    return texts.join(wanted, "doc_id").select("text", "spans").mapInArrow(cut, "chain long, side int, start int, words array<int>")


def _edits(a: np.ndarray, b: np.ndarray) -> int:
    """Most words that two short stretches have in common in order."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int32)
    for word in a:
        take = np.maximum(row[1:], row[:-1] + (b == word))
        row[1:] = np.maximum.accumulate(take)
    return int(row[-1])


def _reach(equal: np.ndarray, worse: int) -> tuple[int, int]:
    """How far an alignment goes on along equal and unequal words, and how many of these are equal."""
    if not len(equal):
        return 0, 0
    worth = np.cumsum(np.where(equal, 1, -worse))
    best = int(worth.argmax())
    return (best + 1, int(equal[: best + 1].sum())) if worth[best] > 0 else (0, 0)


def _blocks(at: np.ndarray, rep_at: np.ndarray, words: np.ndarray, rep_words: np.ndarray, k: int) -> np.ndarray:
    """Rows (first, end, rep_first, rep_end, same, before) of a chain's stretches without a difference in number.

    ``before`` counts the words that the gap in front of a stretch has in common.
    """
    at, rep_at = np.asarray(at, np.int64), np.asarray(rep_at, np.int64)
    end, rep_end = (np.append(x[:1], x[:-1] + k) for x in (at, rep_at))  # of the seed before
    skip = np.maximum(np.maximum(end - at, rep_end - rep_at), 0)  # seeds overlap: what is left of this one
    a, b = at + skip, rep_at + skip
    gap, rep_gap = a - end, b - rep_end
    # words equal in place: of the gap in front, if it is as long on both sides, and of the seed
    even = gap == rep_gap
    ahead = np.where(even, gap, 0)
    places = ahead + k - skip
    begin = np.cumsum(places) - places
    along = np.arange(int(places.sum())) - np.repeat(begin + ahead, places)
    x, y = np.repeat(a, places) + along, np.repeat(b, places) + along
    known = (x < len(words)) & (y < len(rep_words))  # of rows with equal ids the other text may be shorter
    same = np.zeros(len(x), bool)
    same[known] = words[x[known]] == rep_words[y[known]]
    equal = np.append(0, np.cumsum(same))
    common = equal[begin + ahead] - equal[begin]
    own = equal[begin + places] - equal[begin + ahead]
    for i in np.flatnonzero(~even):
        common[i] = _edits(words[end[i] : a[i]], rep_words[rep_end[i] : b[i]])
    joins = (gap == rep_gap) & (gap == common)
    joins[0] = False
    heads = np.flatnonzero(~joins)
    tails = np.append(heads[1:], len(at)) - 1
    total = np.add.reduceat(own + np.where(joins, common, 0), heads)
    return np.stack([a[heads], at[tails] + k, b[heads], rep_at[tails] + k, total, common[heads]], axis=1)


def _counts(first: int, end: int, rep_first: int, rep_end: int, same: int) -> bool:
    return min(end - first, rep_end - rep_first) >= MIN_WORDS and same >= IDENTITY * max(end - first, rep_end - rep_first)


def align(at: np.ndarray, rep_at: np.ndarray, words: np.ndarray, rep_words: np.ndarray, k: int = K) -> list[tuple[int, int, int, int, int]]:
    """(first, end, rep_first, rep_end, same) of the passages along a chain; positions are in the given stretches.

    A chain that is no passage as a whole is cut at gaps: the longest part of it that has the identity is judged on its own,
    and what lies before and behind it likewise. Of more than ``PARTS`` stretches the widest difference is cut first.
    """
    blocks = _blocks(at, rep_at, words, rep_words, k)
    same = np.cumsum(blocks[:, 4] + blocks[:, 5])
    out = []

    def judged(x: int, y: int, low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int, int, int, int] | None:
        first, end, rep_first, rep_end = (int(v) for v in (blocks[x, 0], blocks[y, 1], blocks[x, 2], blocks[y, 3]))
        inner = int(same[y] - same[x] + blocks[x, 4])
        ahead, behind = min(high[0] - end, high[1] - rep_end), min(first - low[0], rep_first - low[1])
        after = words[end : end + ahead] == rep_words[rep_end : rep_end + ahead]
        before = (words[first - behind : first] == rep_words[rep_first - behind : rep_first])[::-1]
        for worse in (2, 4):  # the second reach can't take the identity below its bound
            (far, more), (back, less) = _reach(after, worse), _reach(before, worse)
            found = first - back, end + far, rep_first - back, rep_end + far, inner + more + less
            if _counts(*found):
                return found
        # else as many words more as the identity allows, of which half are equal and the outermost too
        ends = [np.append(0, np.flatnonzero(x) + 1) for x in (before, after)]
        ends = [e[np.arange(len(e)) * 2 >= e] for e in ends]
        gained = [np.append(0, np.cumsum(x))[e] for x, e in zip((before, after), ends)]
        more, longer = inner + gained[0][:, None] + gained[1], ends[0][:, None] + ends[1] + max(end - first, rep_end - rep_first)
        x, y = np.unravel_index(np.where(more >= IDENTITY * longer, longer, -1).argmax(), more.shape)
        back, far = int(ends[0][x]), int(ends[1][y])
        found = first - back, end + far, rep_first - back, rep_end + far, int(more[x, y])
        return found if _counts(*found) else None

    parts = [(0, len(blocks) - 1, (0, 0), (len(words), len(rep_words)))]
    while parts:
        x, y, low, high = parts.pop()
        if x > y:
            continue
        found = judged(x, y, low, high)
        if found is None and y - x >= PARTS:
            gaps = np.maximum(blocks[x + 1 : y + 1, 0] - blocks[x:y, 1], blocks[x + 1 : y + 1, 2] - blocks[x:y, 3]) - blocks[x + 1 : y + 1, 5]
            cut = x + int(gaps.argmax())
            parts += [(x, cut, low, (int(blocks[cut + 1, 0]), int(blocks[cut + 1, 2]))), (cut + 1, y, (int(blocks[cut, 1]), int(blocks[cut, 3])), high)]
            continue
        left, right = x, y
        if found is None and x < y:
            own = blocks[x : y + 1]
            long = np.maximum(own[None, :, 1] - own[:, None, 0], own[None, :, 3] - own[:, None, 2])
            shared = same[None, x : y + 1] - (same[x : y + 1] - own[:, 4])[:, None]
            fits = np.triu(shared >= IDENTITY * long)
            left, right = (x + int(v) for v in np.unravel_index(np.where(fits, long, -1).argmax(), long.shape))
            edge = low if left == x else (int(blocks[left - 1, 1]), int(blocks[left - 1, 3]))
            rim = high if right == y else (int(blocks[right + 1, 0]), int(blocks[right + 1, 2]))
            found = judged(left, right, edge, rim)
        start, stop = (int(blocks[left, 0]), int(blocks[left, 2])), (int(blocks[right, 1]), int(blocks[right, 3]))
        if found is not None:
            out.append(found)
            start, stop = (found[0], found[2]), (found[1], found[3])
        parts += [(x, left - 1, low, start), (right + 1, y, stop, high)]
    return sorted(out)


def _ragged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and where each list begins and the last ends."""
    return lists.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))


def _shared(words: np.ndarray, ends: np.ndarray, rep_words: np.ndarray, rep_ends: np.ndarray) -> np.ndarray:
    """How many words of each stretch its representative's stretch may have anywhere: no alignment has more of them equal.

    Words count as the same if their low bits are, so the number may be too high but not too low.
    """
    owner, rep_owner = (np.repeat(np.arange(len(e) - 1), np.diff(e)) for e in (ends, rep_ends))
    has = np.zeros((len(ends) - 1) * WORD_BITS, bool)
    has[rep_owner * WORD_BITS + rep_words % WORD_BITS] = True
    return np.bincount(owner[has[owner * WORD_BITS + words % WORD_BITS]], minlength=len(ends) - 1)


def passages(docs: DataFrame, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """(doc_id, first_word, n_words, rep_id, rep_first_word, rep_words, same_words, identity): repeated passages.

    Each is one of ``doc_id`` that ``rep_id``, the smallest id with some of its seeds, has as well.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, chars // BUCKET_CHARS)  # whatever the session's partitions: a bucket may send a row to every part
    found = chained(matches(seeds(docs, buckets, hash_bytes), max(LEAST_BUCKETS, buckets // 4), hash_bytes))
    cut = _stretches(docs, found)
    side = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c))).alias(f"{c}{n}")
    cut = cut.groupBy("chain").agg(side(0, "start"), side(1, "start"), F.max(F.when(F.col("side") == 0, F.col("words"))).alias("words0"), F.max(F.when(F.col("side") == 1, F.col("words"))).alias("words1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = {c: batch.column(c).to_numpy() for c in ("doc_id", "rep", "start0", "start1")}
            lists = {c: _ragged(batch.column(c)) for c in ("at", "rep_at", "words0", "words1")}
            rows = []
            for i in np.flatnonzero(_shared(*lists["words0"], *lists["words1"]) >= IDENTITY * MIN_WORDS).tolist():
                doc_id, rep, start0, start1 = (int(x[i]) for x in numbers.values())
                at, rep_at, words0, words1 = (values[ends[i] : ends[i + 1]] for values, ends in lists.values())
                for first, end, rep_first, rep_end, same in align(at - start0, rep_at - start1, words0, words1):
                    longer = max(end - first, rep_end - rep_first)
                    rows.append((doc_id, first + start0, end - first, rep, rep_first + start1, rep_end - rep_first, same, same / longer))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=columns)

    columns = ["doc_id", "first_word", "n_words", "rep_id", "rep_first_word", "rep_words", "same_words", "identity"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    schema = "doc_id long, first_word int, n_words int, rep_id long, rep_first_word int, rep_words int, same_words int, identity double"
    return found.join(cut, "chain").mapInArrow(run, schema)
