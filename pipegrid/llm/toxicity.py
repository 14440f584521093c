"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the embedding of its hash beside the peaks, slot by slot, of the embeddings of its character n-grams
(hashed, with marks for the word's ends). Forward and backward gated units read a window of ``WINDOW`` words, attention pools their states, and a
linear unit gives the window's logit. Windows begin every ``STRIDE`` words, so that they overlap by half; every
window of the whole text is scored, and the largest logit, calibrated on the training documents, is the text's score.

The first embedding slots are fixed: the log-odds of toxic documents that hold the word or n-gram. Training documents are
parted in two folds, and each sees the log-odds of the other fold, so that the network learns how far they can be trusted on new
documents. Only document labels are known; training alternates between scoring the training documents' windows and
learning from the likeliest windows of toxic documents and the likeliest and some random windows of others. It takes at
most ``TOXIC_DOCS`` and ``CLEAN_DOCS`` labelled documents by a hash of their id, ``DOC_WINDOWS`` evenly spaced windows of each, and
the same number of steps whatever the size of the table.

A null text or one without words has the score of an empty window. A null id counts as not held out; null or repeated
labels: a document is toxic if any of its labels is 1, and unlabelled if all are null. Without both classes every
score is 0. Repeated rows have equal scores. Pieces of long texts are scored one after the other.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipegrid.llm.langid import held_out

WINDOW, STRIDE = 32, 16
BUCKETS = 1 << 18
EMBED, HIDDEN = 4, 8
GRAMS = (3, 4, 5)
TOXIC_DOCS, CLEAN_DOCS, DOC_WINDOWS = 1_500, 2_500, 256
ROUNDS, STEPS, BATCH, RATE = 5, 60, 256, 0.01
WORD_DROPOUT = 0.5
TABLE_RATE = 0.1  #: of the rate, for embeddings
ASIDE = 5  #: every fifth sampled document is kept for the calibration
CUT = 0.3
NEVER = -10.0  #: the value of no n-gram
SEED = 42
PIECE = 1 << 17  #: characters of a text that are cut into words together
LOT = 1 << 11  #: windows that are scored together
SLICE = 1 << 13  #: distinct words that are looked up together
_WORDS = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)

Params = dict[str, np.ndarray]


def words_of(text: str | None) -> Iterator[list[str]]:
    """A text's lower-case words, a piece at a time; pieces end at white space."""
    text = text or ""
    start = 0
    while len(text) - start > PIECE:
        space = re.compile(r"\s").search(text, start + PIECE)
        if space is None:
            break
        yield _WORDS.findall(text[start : space.start()].lower())
        start = space.start()
    yield _WORDS.findall(text[start:].lower())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of distinct words: of the word, of its n-grams one word after the other, and where each word's begin.

    Each word has len(GRAMS) entries per byte; BUCKETS stands for n-grams that its end cuts off.
    """
    parts = [_features(words[first : first + SLICE]) for first in range(0, len(words), SLICE)] or [_features([])]
    lengths = np.concatenate([n for _, _, n in parts])
    starts = len(GRAMS) * (np.cumsum(lengths) - lengths)
    return np.concatenate([o for o, _, _ in parts]), np.concatenate([g for _, g, _ in parts]), starts


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, n-gram buckets and marked lengths of some words."""
    own = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS for w in words), np.int32, len(words))
    marked = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.repeat(np.cumsum(lengths), lengths)
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    padded = np.concatenate([data, np.zeros(max(GRAMS), np.uint64)])
    places = np.arange(len(data))
    grams = np.empty((len(data), len(GRAMS)), np.int32)
    for column, size in enumerate(GRAMS):
        rolled = np.full(len(data), size, np.uint64)
        for k in range(size):
            rolled = (rolled * np.uint64(257) + padded[k : k + len(data)]) & np.uint64(0xFFFFFFFFFFFF)
        bucket = ((rolled * _MIX) >> np.uint64(40)).astype(np.int64) % BUCKETS
        grams[:, column] = np.where(places + size <= ends, bucket, BUCKETS)
    return own, grams.ravel(), lengths


def _embed(p: Params, own: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Inputs of distinct words: their own embedding beside the largest n-gram value of every slot."""
    if not len(own):
        return np.zeros((0, 2 * EMBED), np.float32)
    peaks = np.zeros((len(own), EMBED), np.float32)
    for first in range(0, len(own), SLICE):  # in slices, so that memory stays bounded
        last = min(len(own), first + SLICE)
        stop = starts[last] if last < len(own) else len(grams)
        peaks[first:last] = np.maximum.reduceat(p["chars"][grams[starts[first] : stop]], starts[first:last] - starts[first], axis=0)
    return np.concatenate([p["words"][own], peaks], axis=1)


def new_params(seed: int = SEED) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"words": draw(BUCKETS + 1, EMBED, scale=0.1), "chars": draw(BUCKETS + 1, EMBED, scale=0.1)}
    p["chars"][-1] = NEVER
    for side in "fb":
        p["in" + side] = draw(2 * EMBED, 3 * HIDDEN, scale=(2 * EMBED) ** -0.5)
        p["bias" + side] = np.zeros(3 * HIDDEN, np.float32)
        p["rec" + side] = draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
    p["look"] = draw(2 * HIDDEN, scale=0.5)
    p["out"] = draw(2 * HIDDEN, scale=0.5)
    p["base"] = np.full(1, -1.0, np.float32)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _run(p: Params, side: str, inputs: np.ndarray, ids: np.ndarray, keep: list | None) -> np.ndarray:
    """States (windows, WINDOW, HIDDEN) of one direction; ``ids`` of -1 are padding, whose state is zero."""
    h = HIDDEN
    projected = np.zeros((len(inputs) + 1, 3 * h), inputs.dtype)  # the last row is for padding
    np.matmul(inputs, p["in" + side], out=projected[:-1])
    projected[:-1] += p["bias" + side]
    states = np.zeros((len(ids), ids.shape[1], h), np.float32)
    state = np.zeros((len(ids), h), np.float32)
    steps = range(ids.shape[1]) if side == "f" else range(ids.shape[1] - 1, -1, -1)
    for t in steps:
        given, back = projected[ids[:, t]], state @ p["rec" + side]
        gates = _sigmoid(given[:, : 2 * h] + back[:, : 2 * h])
        reset, update = gates[:, :h], gates[:, h:]
        fresh = np.tanh(given[:, 2 * h :] + reset * back[:, 2 * h :])
        moved = fresh + update * (state - fresh)
        moved *= (ids[:, t] >= 0)[:, None]
        if keep is not None:
            keep.append((t, state, back, reset, update, fresh))
        state = moved
        states[:, t] = state
    return states


def _pool(p: Params, states: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, attention and pooled states."""
    scores = np.where(ids >= 0, states @ p["look"], -1e9)
    scores -= scores.max(axis=1, keepdims=True)
    attention = np.exp(scores)
    attention /= attention.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", attention, states)
    return pooled @ p["out"] + p["base"][0], attention, pooled


def logits(p: Params, inputs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The logit of every window; rows of ``ids`` index ``inputs``."""
    out = np.empty(len(ids), np.float32)
    for first in range(0, len(ids), LOT):
        part = ids[first : first + LOT]
        states = np.concatenate([_run(p, side, inputs, part, None) for side in "fb"], axis=2)
        out[first : first + LOT] = _pool(p, states, part)[0]
    return out


def gradients(p: Params, feats, ids: np.ndarray, target: np.ndarray, weight: np.ndarray, silent: np.ndarray | None = None) -> tuple[float, Params]:
    """Weighted cross-entropy of windows and its gradients. ``silent`` marks words whose word input is dropped."""
    own, grams, starts = feats
    h = HIDDEN
    inputs = _embed(p, own, grams, starts)
    peaks = inputs[:, EMBED:]
    if silent is not None:
        inputs[silent, :EMBED] = 0
    kept = {"f": [], "b": []}
    states = np.concatenate([_run(p, side, inputs, ids, kept[side]) for side in "fb"], axis=2)
    value, attention, pooled = _pool(p, states, ids)
    chance = _sigmoid(value)
    loss = float(np.sum(weight * (np.logaddexp(0, value) - target * value)))
    g: Params = {}
    slope = (weight * (chance - target)).astype(np.float32)
    g["out"], g["base"] = slope @ pooled, np.array([slope.sum()], np.float32)
    d_pooled = slope[:, None] * p["out"]
    through = np.einsum("nh,nth->nt", d_pooled, states)
    d_scores = attention * (through - np.sum(attention * through, axis=1, keepdims=True))
    g["look"] = np.einsum("nt,nth->h", d_scores, states)
    d_states = attention[:, :, None] * d_pooled[:, None, :] + d_scores[:, :, None] * p["look"]
    d_inputs = np.zeros_like(inputs)
    for side, first in (("f", 0), ("b", h)):
        d_projected = np.zeros((len(inputs) + 1, 3 * h), np.float32)
        d_rec = np.zeros_like(p["rec" + side])
        carried = np.zeros((len(ids), h), np.float32)
        for t, before, back, reset, update, fresh in reversed(kept[side]):
            d = (d_states[:, t, first : first + h] + carried) * (ids[:, t] >= 0)[:, None]
            d_fresh = d * (1 - update) * (1 - fresh * fresh)
            d_gates = np.concatenate([d_fresh * back[:, 2 * h :] * reset * (1 - reset), d * (before - fresh) * update * (1 - update)], axis=1)
            d_back = np.concatenate([d_gates, d_fresh * reset], axis=1)
            np.add.at(d_projected, ids[:, t], np.concatenate([d_gates, d_fresh], axis=1))
            d_rec += before.T @ d_back
            carried = d * update + d_back @ p["rec" + side].T
        d_projected = d_projected[:-1]
        g["rec" + side], g["in" + side], g["bias" + side] = d_rec, inputs.T @ d_projected, d_projected.sum(axis=0)
        d_inputs += d_projected @ p["in" + side].T
    d_words = d_inputs[:, :EMBED]
    if silent is not None:
        d_words[silent] = 0
    sizes = np.diff(np.append(starts, len(grams)))
    spread = np.repeat(d_inputs[:, EMBED:], sizes, axis=0) * (p["chars"][grams] == np.repeat(peaks, sizes, axis=0))
    g["words rows"], g["words"] = _by_row(own, d_words)
    g["chars rows"], g["chars"] = _by_row(grams[grams < BUCKETS], spread[grams < BUCKETS])
    return loss, g


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table rows that have a gradient, and its sum."""
    order = np.argsort(rows, kind="stable")
    found, first = np.unique(rows[order], return_index=True)
    return found, np.add.reduceat(values[order], first, axis=0)


def window_ids(numbers: np.ndarray) -> np.ndarray:
    """Overlapping windows (rows) over a text's word numbers; -1 pads the last. A text without words has one of padding."""
    n = len(numbers)
    starts = np.arange(0, max(1, n - STRIDE if n > WINDOW else 1), STRIDE)
    padded = np.concatenate([numbers, np.full(WINDOW, -1, numbers.dtype)])
    return padded[starts[:, None] + np.arange(WINDOW)]


def _numbered(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, windows of all texts, and the text each window belongs to."""
    known: dict[str, int] = {}
    windows, owner = [], []
    for i, text in enumerate(texts):
        carry: list[int] = []
        first = True
        for words in words_of(text):
            numbers = carry + [known.setdefault(w, len(known)) for w in words]
            if first or len(numbers) > len(carry):
                rows = window_ids(np.array(numbers, np.int32))
                windows.append(rows)
                owner.append(np.full(len(rows), i, np.int32))
            carry, first = numbers[-STRIDE:], False
    return list(known), np.concatenate(windows), np.concatenate(owner)


def text_logits(p: Params, texts: list[str | None]) -> np.ndarray:
    """The largest window logit of every text."""
    out = np.full(len(texts), -np.inf)
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") <= 4 * PIECE):
            size += len(texts[last] or "")
            last += 1
        for part, values in _scored(p, texts[first:last]):
            np.maximum.at(out, first + part, values)
        first = last
    return out


def _scored(p: Params, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    known, windows, owner = _numbered(texts)
    inputs = _embed(p, *features(known)) if known else np.zeros((0, 2 * EMBED), np.float32)
    yield owner, logits(p, inputs, windows)


def fit(texts: list[str | None], toxic: np.ndarray, seed: int = SEED) -> Params:
    """Train on documents with labels; the calibration is in ``scale``."""
    rng = np.random.default_rng(seed)
    known, windows, owner = _numbered(texts)
    feats = features(known)
    del known
    keep = np.concatenate([rows if len(rows) <= DOC_WINDOWS else rows[np.linspace(0, len(rows) - 1, DOC_WINDOWS).astype(int)] for rows in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1)])
    if len(keep) < len(owner):
        windows, owner = windows[keep], owner[keep]
    bounds = np.append(np.flatnonzero(np.append(True, np.diff(owner) > 0)), len(owner))
    sizes = np.append(feats[2], len(feats[1]))
    p = new_params(seed)
    aside = np.zeros(len(toxic), bool)
    for kind in (0, 1):
        members = rng.permutation(np.flatnonzero(toxic == kind))
        aside[members[::ASIDE] if len(members) >= 2 * ASIDE else members[:0]] = True
    fold = np.where(aside, -1, 0)
    for kind in (0, 1):
        fold[rng.permutation(np.flatnonzero((toxic == kind) & ~aside))[::2]] = 1
    odds = [_odds(feats, sizes, windows, bounds, toxic, fold == other) for other in (1, 0)]
    first_moment = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    values = np.zeros(len(windows))
    part_of = fold[owner]
    for turn in range(ROUNDS):
        for side in (0, 1):
            _lean(p, odds[side])
            values[part_of == side] = logits(p, _embed(p, *feats), windows[part_of == side])
        for _ in range(STEPS):
            side = step % 2
            _lean(p, odds[side])
            positive, negative = (np.flatnonzero((toxic == kind) & (fold == side)) for kind in (1, 0))
            if not len(positive) or not len(negative):
                positive, negative = np.flatnonzero(toxic == 1), np.flatnonzero(toxic == 0)
            chosen = []
            for docs, bad in ((positive, True), (negative, False)):
                for d in rng.choice(docs, BATCH // 2):
                    rows = np.arange(bounds[d], bounds[d + 1])
                    if rng.random() < (0.2 if bad else 0.5):
                        chosen.append(rng.choice(rows))
                    else:
                        chosen.append(rows[np.argmax(values[rows] + rng.gumbel(size=len(rows)))])
            ids = windows[chosen]
            used, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            if used[0] == -1:
                used, local = used[1:], local - 1
            if not len(used):
                continue
            lengths = sizes[used + 1] - sizes[used]
            at = np.repeat(sizes[used] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
            part = (feats[0][used], feats[1][at], np.append(0, np.cumsum(lengths)[:-1]))
            target = toxic[owner[chosen]].astype(np.float32)
            weight = np.full(len(ids), 1 / len(ids), np.float32)
            _, g = gradients(p, part, local, target, weight, rng.random(len(used)) < WORD_DROPOUT)
            for table in ("words", "chars"):
                g[table][:, 0] = 0
            step += 1
            rate = RATE * (1 - 0.9 * step / (ROUNDS * STEPS))
            for k in first_moment:
                rows, pace = (g[f"{k} rows"], TABLE_RATE) if k in ("words", "chars") else (slice(None), 1.0)
                grad = g[k]
                first_moment[k][rows] += 0.1 * (grad - first_moment[k][rows])
                second[k][rows] += 0.01 * (grad * grad - second[k][rows])
                p[k][rows] -= pace * rate * (first_moment[k][rows] / (1 - 0.9**step)) / (np.sqrt(second[k][rows] / (1 - 0.99**step)) + 1e-7)
    _lean(p, _odds(feats, sizes, windows, bounds, toxic, ~aside))
    best = np.maximum.reduceat(logits(p, _embed(p, *feats), windows), bounds[:-1])
    judged = aside if aside.any() else ~aside
    p["scale"] = _calibrate(best[judged], toxic[judged])
    return p


def _lean(p: Params, odds: Params) -> None:
    """Set the fixed first slots."""
    for name, values in odds.items():
        p[name][:, 0] = values
    p["chars"][-1] = NEVER


def _odds(feats, sizes: np.ndarray, windows: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, used: np.ndarray) -> Params:
    """Shrunken log-odds of a bucket's presence in the used toxic documents against the others."""
    seen = {name: np.zeros((2, BUCKETS + 1)) for name in ("words", "chars")}
    for d in np.flatnonzero(used):
        words = np.unique(windows[bounds[d] : bounds[d + 1]])
        words = words[words >= 0]
        if not len(words):
            continue
        seen["words"][toxic[d], np.unique(feats[0][words])] += 1
        lengths = sizes[words + 1] - sizes[words]
        at = np.repeat(sizes[words] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        seen["chars"][toxic[d], np.unique(feats[1][at])] += 1
    totals = np.bincount(toxic[used], minlength=2)
    out = {}
    for name, (clean, bad) in seen.items():
        odds = np.log((bad + 0.5) / (totals[1] + 1)) - np.log((clean + 0.5) / (totals[0] + 1))
        out[name] = (0.5 * np.clip(odds, -3, 5) * (clean + bad) / (clean + bad + 4)).astype(np.float32)
    return out


def _calibrate(value: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Slope and offset of a logistic curve; targets stay off 0 and 1, so that parted classes have a finite answer."""
    target = np.where(toxic == 1, (np.sum(toxic == 1) + 1) / (np.sum(toxic == 1) + 2), 1 / (np.sum(toxic == 0) + 2))
    slope, offset = 1.0, 0.0
    for _ in range(200):
        chance = _sigmoid(slope * value + offset)
        spread = chance * (1 - chance) + 1e-6
        gradient = np.array([np.sum((chance - target) * value) + 0.1 * (slope - 1), np.sum(chance - target)])
        curve = np.array([[np.sum(spread * value * value) + 0.1, np.sum(spread * value)], [np.sum(spread * value), np.sum(spread) + 1e-3]])
        move = np.clip(np.linalg.solve(curve, gradient), -0.5, 0.5)
        slope, offset = slope - move[0], offset - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return np.array([max(slope, 0.05), offset])


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Params | None:
    """Parameters learned from labelled documents that are not held out; None without both classes.

    The sample's ids, a bounded number, are broadcast; its texts meet in one task, which trains the network and returns
    its parameters, so that neither texts nor training take memory on the driver. A lost task starts again and learns the same.
    """
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic is not null and doc_id is not null").filter(~held_out())
    order = F.xxhash64(F.lit(SEED), "doc_id")
    drawn = known.filter("toxic = 1").orderBy(order, "doc_id").limit(toxic_docs).unionByName(known.filter("toxic = 0").orderBy(order, "doc_id").limit(clean_docs))

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [row for frame in frames for row in zip(frame["doc_id"], frame["text"], frame["toxic"])]
        rows.sort(key=lambda r: (r[0], r[1] or ""))
        toxic, texts = np.array([t for _, _, t in rows], np.int64), [text for _, text, _ in rows]
        del rows
        if len(set(toxic)) == 2:
            for name, values in fit(texts, toxic).items():
                yield pd.DataFrame({"name": [name], "kind": [values.dtype.str], "shape": [list(values.shape)], "data": [values.tobytes()]})

    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic").repartition(1)
    found = sample.mapInPandas(learn, "name string, kind string, shape array<int>, data binary").collect()
    return {r.name: np.frombuffer(r.data, r.kind).reshape(r.shape) for r in found} or None


def scorer(params: Params | None):
    """The column function from a text to its score."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if params is None:
                yield pd.Series(np.zeros(len(texts)))
            elif len(texts):
                slope, offset = params["scale"]
                yield pd.Series(_sigmoid(slope * text_logits(params, list(texts)) + offset))
            else:
                yield pd.Series([], dtype="float64")

    return score


def score(docs: DataFrame, params: Params | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = docs.select("doc_id", held_out().alias("held_out"), scorer(params)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_clean(docs: DataFrame, params: Params | None) -> DataFrame:
    """The documents whose score stays below the cut, all columns kept. No shuffle."""
    packed = docs.select(F.struct("*").alias("doc"))
    return packed.filter(scorer(params)("doc.text") < CUT).select("doc.*")
