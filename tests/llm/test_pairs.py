"""Fingerprints, near duplicates, passages and decontamination against brute force, and their odd cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pipegrid.llm import chaining, decontam, simhash, spotsigs
from pipegrid.llm.common import components
from tests.llm.conftest import prose


def near_texts(seed=1, n=30):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    for base in texts[:12]:
        words = base.split()
        if words:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    return [*texts, texts[0], texts[1].upper(), "", None, "one two", "one  two"]


def classes(nodes, linked):
    head = {x: x for x in nodes}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in linked:
        low, high = sorted((find(a), find(b)))
        head[high] = low
    return {x: find(x) for x in nodes}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20), *((30 + i, 31 + i) for i in range(40))]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == classes({x for e in edges for x in e}, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(make_docs):
    texts = near_texts()
    prints = [plain_print(t) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = classes(range(len(texts)), pairs)
    found = simhash.near_duplicates(make_docs(texts)).select("doc_id", simhash.hex_print().alias("fp"), "component_id").collect()
    assert {(r.doc_id, r.fp, r.component_id) for r in found} == {(i, f"{p:016x}", want[i]) for i, p in enumerate(prints)}


def test_simhash_dense_groups(spark):
    """Prints in one small region: every linked pair ends in one class whatever cell it meets in."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(250)} | {0, 1, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = classes(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])
    got = {r.node: r.component for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    assert all(got.get(p, p) == c for p, c in want.items())


def test_simhash_pieces_equal_the_whole():
    text = prose(random.Random(2), 300_000)
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_print(text)


def test_deduplicate_odd(odd_docs, no_docs):
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 7, 8] and ids.count(None) == 1
    assert simhash.deduplicate(no_docs).count() == 0


def plain_spots(text):
    anchors, words = set(spotsigs.anchor_words()), re.findall(r"[^\W_]+", (text or "").lower())
    out = set()
    for i, word in enumerate(words):
        chain, run = [], 0
        for other in words[i + 1 :] if word in anchors else ():
            run = run + 1 if other in anchors else 0
            if run > spotsigs.SKIP:
                break
            if not run:
                chain.append(other)
            if len(chain) == spotsigs.CHAIN:
                out.add((word, *chain))
                break
    return out or {("whole", *words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_spotsigs_equals_brute_force(make_docs):
    texts = [t for t in near_texts(4) if t is not None]
    rows = spotsigs.fingerprint_edits(make_docs(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, following = texts[r.doc_id], texts[r.doc_id - 1]  # id 0 is followed by the last
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own = plain_spots(text)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(own, plain_spots(edited)))
        assert r.near_next == pytest.approx(jaccard(own, plain_spots(following)))
        assert r.fingerprint.startswith(f"{len(own)}-")
    by_text = {(texts[r.doc_id], r.fingerprint) for r in rows}
    assert len(by_text) == len({t for t, _ in by_text})


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_spot_pairs_lose_nothing(make_docs, threshold):
    rng = random.Random(6)
    texts = [prose(rng, 400) for _ in range(12)]
    texts += [" ".join(w if rng.random() > 0.004 * k else "other" for w in texts[k % 12].split()) for k in range(24)]
    digests = {r.doc_id: r.d for r in make_docs(texts).select("doc_id", spotsigs.digest(spotsigs.signatures(F.col("text"))).alias("d")).collect()}
    want = {frozenset((digests[a], digests[b])) for a, b in itertools.combinations(range(len(texts)), 2) if digests[a] != digests[b] and jaccard(plain_spots(texts[a]), plain_spots(texts[b])) >= threshold}
    got = spotsigs.near_pairs(make_docs(texts), threshold).collect()
    assert {frozenset((r.a, r.b)) for r in got} == want and len(got) == len(want) > 0


def test_spotsigs_odd(odd_docs, no_docs, make_docs):
    rows = spotsigs.fingerprint_edits(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id in (2, 3)}) == 1
    assert spotsigs.fingerprint_edits(no_docs).count() == 0
    alone = spotsigs.fingerprint_edits(make_docs(["just one of them here"])).collect()
    assert alone[0].near_next == 1.0
    sparse = spotsigs.fingerprint_edits(make_docs([(-(1 << 62), "the first of all"), (5, "a second one"), (1 << 62, "the third")])).collect()
    assert len(sparse) == 3


BENCH = "item_id long, text string"
QUESTION = "If Tom Miller has 5 apples and buys 12.5 kg of ripe pears from the market near Berlin, how many pieces of fruit can he carry home today"


def test_decontamination(spark, make_docs):
    bench = spark.createDataFrame([(1, QUESTION), (2, "short item here"), (3, None), (4, ""), (5, QUESTION)], BENCH)
    rng = random.Random(7)
    filler = prose(rng, 40)
    texts = [
        f"{filler} {QUESTION} {filler}",  # copy
        QUESTION.replace("Tom Miller", "Ann Baker").replace("5", "77").replace("12.5 kg", "3 lb").replace("Berlin", "Paris"),  # other slots
        QUESTION.lower(),
        QUESTION.upper(),
        filler,
        "the answer is a short item here I think",
        None,
        "",
        " ".join(QUESTION.split()[:9]),  # a few words only
    ]
    rows = decontam.report(make_docs(texts), bench).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, set()).add(r.item_id)
    assert found == {0: {1, 5}, 1: {1, 5}, 2: {1, 5}, 3: {1, 5}, 5: {2}}
    assert [r.doc_id for r in decontam.decontaminate(make_docs(texts), bench).orderBy("doc_id").collect()] == [4, 6, 7, 8]


def test_inconsistent_slots_do_not_count(spark, make_docs):
    item = "Ann gives 5 red balls to her friend and Ann then takes 5 back again while Ann counts all 5 of them"
    other = "Bob gives 6 red balls to her friend and Joe then takes 7 back again while Eve counts all 8 of them"
    bench = spark.createDataFrame([(1, item)], BENCH)
    rows = decontam.report(make_docs([item, other]), bench).collect()
    assert [r.doc_id for r in rows] == [0]


def test_decontamination_odd(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "The cat and the dog sat on the mat of the house.")], BENCH)
    kept = decontam.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
    assert decontam.report(no_docs, bench).count() == 0
    assert decontam.report(odd_docs, spark.createDataFrame([], BENCH)).count() == 0


def test_passages(make_docs):
    rng = random.Random(8)
    shared = prose(rng, 70).split()
    fuzzy = [w if i % 17 else "x" for i, w in enumerate(shared)]
    gapped = shared[:35] + ["new", "words", "between"] + shared[35:]
    texts = [prose(rng, 100) + " " + " ".join(p) + " " + prose(rng, 100) for p in (shared, shared, fuzzy, gapped)]
    texts += [prose(rng, 200), " ".join(shared[:25]), "", None, "few words", "again " * 300]
    rows = {r.doc_id: r for r in chaining.passages(make_docs(texts)).collect()}
    assert set(rows) == {1, 2, 3} and all(r.rep_id == 0 for r in rows.values())
    assert (rows[1].first_word, rows[1].n_words, rows[1].rep_first_word, rows[1].identity) == (100, 70, 100, 1.0)
    assert rows[2].n_words >= 60 and 0.9 < rows[2].identity < 1
    assert rows[3].n_words - rows[3].rep_words == 3 and 70 <= rows[3].same_words <= 72  # a word beyond may agree by chance


@pytest.mark.parametrize("gap", [30, 60, 100, 150, 250])
def test_passages_beside_each_other(make_docs, gap):
    """Two passages that documents share in the same order are both found, whatever lies between them."""
    rng = random.Random(gap)
    one, two = prose(rng, 60), prose(rng, 60)
    texts = [" ".join([prose(rng, 50), one, prose(rng, gap), two, prose(rng, 50)]) for _ in range(3)]
    found = chaining.passages(make_docs(texts)).collect()
    for doc in (1, 2):
        for at in (50, 110 + gap):
            assert any(r.doc_id == doc and r.rep_id == 0 and r.first_word <= at and r.first_word + r.n_words >= at + 60 and r.identity >= 0.8 for r in found)


def test_passages_beyond_holders_of_parts(make_docs):
    """Small ids hold the halves of a passage and take its short seeds; the two documents that hold it all are still linked."""
    rng = random.Random(11)
    texts = []
    for trial in range(30):
        shared = prose(rng, 60, [f"w{rng.getrandbits(40):x}" for _ in range(300)]).split()
        for doc_id, words in ((1, shared[:30]), (2, shared[30:]), (100, shared), (200, shared)):
            texts.append((1000 * trial + doc_id, " ".join([prose(rng, 40), *words, prose(rng, 40)])))
    found = {(r.doc_id, r.rep_id) for r in chaining.passages(make_docs(texts)).collect()}
    assert {(1000 * t + 200, 1000 * t + 100) for t in range(30)} <= found


@pytest.mark.parametrize("words, every, share", [(60, 8, None), (100, 5, None), (55, None, 0.15), (50, None, 0.2)])
def test_fuzzy_passages(make_docs, words, every, share):
    """Passages of at least the identity are found whatever words differ."""
    rng = random.Random(12)
    texts = []
    for trial in range(40):
        shared = prose(rng, words).split()
        changed = range(every - 1, words, every) if every else rng.sample(range(1, words - 1), round(share * words))
        other = [f"x{i}" if i in set(changed) else w for i, w in enumerate(shared)]
        texts += [" ".join([prose(rng, 30), *p, prose(rng, 30)]) for p in (shared, other)]
    found = {(r.doc_id, r.rep_id) for r in chaining.passages(make_docs(texts)).collect()}
    assert sum((2 * t + 1, 2 * t) in found for t in range(40)) >= 38


def test_passages_of_frequent_seeds(make_docs):
    """All seeds of the passage lie in both documents many times; it stands first in one and last in the other."""
    rng = random.Random(14)
    runs = [[f"w{10 * i + j}" for j in range(9)] for i in range(6)]
    strange = (f"z{i}" for i in itertools.count())
    passage = lambda mark: [w for i, run in enumerate(runs) for w in [*run, f"{mark}{i}"]]

    def scattered():
        places = [run for run in runs for _ in range(12)]
        rng.shuffle(places)
        return [w for run in places for w in [*run, *(next(strange) for _ in range(30))]]

    texts = [" ".join([*passage("x"), *scattered()]), " ".join([*scattered(), *passage("y")])]
    start = len(texts[1].split()) - 60
    found = chaining.passages(make_docs(texts)).collect()
    assert any(r.doc_id == 1 and r.rep_id == 0 and r.first_word == start and r.n_words >= 59 and r.rep_first_word == 0 for r in found)


@pytest.mark.parametrize("held", [1 << 18, 1 << 12])
def test_chains_of_periodic_texts(monkeypatch, held):
    """Listed places make one passage of a periodic text; smaller squares find what all pairs together do."""
    monkeypatch.setattr(chaining, "PAIRS_HELD", held)
    words = np.array([i % 3 for i in range(2000)], np.uint64)
    found, at = chaining.minimizers(words)
    ids = np.repeat([1, 2], len(at))
    met = chaining._met(np.tile(found.view(np.uint64), 2), ids, np.tile(at * len(chaining.RUNS), 2).astype(np.uint32))
    assert len(met) == 2 * len(at)  # not a row for each pair
    made = list(chaining.all_chains(met["pair"].to_numpy()))
    assert len(made) == 1 and made[0][0] == (0, 0) and made[0][-1] == (1996, 1996)
    # of the same places in another order, every stretch that is in both is found
    shifted = np.concatenate([words[:900], np.arange(10, 90, dtype=np.uint64), words[901:1600]])
    found2, at2 = chaining.minimizers(shifted)
    both = np.concatenate([found, found2]).view(np.uint64)
    met = chaining._met(both, np.repeat([1, 2], [len(at), len(at2)]), np.append(at, at2).astype(np.uint32) * len(chaining.RUNS))
    spans = [(c[0][0], c[-1][0] + chaining.K) for c in chaining.all_chains(met["pair"].to_numpy())]
    for first in (0, 100, 850, 985, 1500):
        assert any(a <= first and b >= first + 45 for a, b in spans)


def test_chains_equal_quadratic_search():
    rng = random.Random(9)
    for _ in range(30):
        pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(25)})
        best = {}
        for a, b in pairs:
            before = [best[p] - chaining.GAP_COST * (a - p[0] + b - p[1]) for p in best if p[0] < a and p[1] < b]
            best[a, b] = chaining.K + max([0, *before])
        chain = chaining.chains(pairs)
        if chain:
            worth = chaining.K * len(chain[0]) - chaining.GAP_COST * sum(y[0] - x[0] + y[1] - x[1] for x, y in itertools.pairwise(chain[0]))
            assert worth == pytest.approx(max(best.values()))
        used = [p for c in chain for p in c]
        assert len(used) == len(set(used))


def test_runs_of_other_length_never_meet():
    """A hash that two kinds of seeds share is no match, and the representative of either kind keeps its own."""
    kinds = len(chaining.RUNS)
    at = lambda place, kind: place * kinds + kind
    met = chaining._met(np.array([7, 7], np.uint64), np.array([1, 2]), np.array([at(0, 3), at(100, 0)], np.uint64))
    assert len(met) == 0
    met = chaining._met(np.full(4, 7, np.uint64), np.array([1, 2, 3, 3]), np.array([at(5, 3), at(100, 0), at(9, 0), at(40, 3)], np.uint64))
    more = chaining.RUNS[3][0] - chaining.K
    want = {(3, 2, 9 << 32 | 100), (3, 1, 40 << 32 | 5), (3, 1, (40 + more) << 32 | (5 + more))}
    assert {tuple(r) for r in met.itertuples(index=False)} == want


def test_passages_with_forced_collisions(make_docs):
    rng = random.Random(31)
    words = [f"w{i}" for i in range(4000)]
    block = " ".join(rng.choice(words) for _ in range(60))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 90))) for _ in range(30)]
    texts += [f"{texts[3]} {block} {texts[4]}", f"{texts[5]} {block}"]
    docs = make_docs(texts)
    plain = {tuple(r) for r in chaining.passages(docs).collect()}
    assert any((r[0], r[2], r[3]) == (31, 60, 30) for r in plain)
    # two bytes of a hash confuse many seeds: false matches are dropped by alignment, and nothing breaks
    assert all(r[6] >= 0.8 * r[2] >= 32 for r in map(tuple, chaining.passages(docs, 2).collect()))


def test_passages_free_their_shuffles(spark, make_docs):
    """Seeds and matches leave no files behind once the chains are written."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        every = disk.getAllFiles()
        return {every.apply(i).getName() for i in range(every.size()) if every.apply(i).getName().startswith("shuffle_")}

    before = files()
    text = prose(random.Random(3), 80)
    found = chaining.chained(chaining.matches(chaining.seeds(make_docs([text, text]), 8), 8))
    assert len(found.collect()) == 1
    assert not {n for n in files() - before if n.endswith(".data")}


def test_buckets_do_not_follow_the_session(spark, make_docs, monkeypatch):
    """A bucket may send a row to every part, so their numbers follow the input alone."""
    seen = []
    monkeypatch.setattr(chaining, "chained", lambda met: met)
    monkeypatch.setattr(chaining, "matches", lambda found, parts, _bytes: seen.append(parts) or found)
    monkeypatch.setattr(chaining, "_stretches", lambda docs, found: 1 / 0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("4", "300"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            with pytest.raises(ZeroDivisionError):
                chaining.passages(make_docs(["a few words"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == chaining.LEAST_BUCKETS


def test_shared_words_bound_every_alignment():
    rng = np.random.default_rng(5)
    for _ in range(200):
        words = rng.integers(0, 30, 120)
        other = np.where(rng.random(120) < 0.2, rng.integers(0, 60, 120), words)
        at = np.sort(rng.choice(110, 6, replace=False))
        most = chaining._shared(words, np.array([0, 120]), other, np.array([0, 120]))[0]
        assert all(same <= most for *_, same in chaining.align(at, at, words, other))
    ends = np.array([0, 2, 2, 5])
    assert list(chaining._shared(np.array([1, 2, 1, 1, 3]), ends, np.array([2, 1, 3, 1]), np.array([0, 1, 2, 4]))) == [1, 0, 3]


def test_words_are_those_of_the_expression():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x30000)]))
    texts = ["", " ", "Plain_ASCII text, 2 words\x1cand\tmore!", "Ärger \u00a0 ÉTÉ\u2028x\u00b2 \u0130I", *(c.join(["a", "b"]) for c in every[:0x3000]), every]
    for text in texts:
        assert chaining.words_of(text) == chaining._WORDS.findall(text.lower())


def test_hashes_of_words():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcéß世x_9") for _ in range(rng.randint(1, 50))) for _ in range(3000)] + ["a", "b" * 31, "b" * 32, "\ud800"]
    want = [xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in words]
    assert chaining.hashes_of(words).tolist() == want and len(chaining.hashes_of([])) == 0
    assert [chaining.hashes_of([w])[0] for w in words[:50]] == want[:50]


def test_minimizers_cover_every_run():
    import numpy as np

    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    for _ in range(20):
        at = int(rng.integers(0, 280))
        run = shared[at : at + chaining.K + chaining.SPAN - 1]
        other = np.concatenate([rng.integers(0, 1 << 60, 50).astype(np.uint64), run, rng.integers(0, 1 << 60, 50).astype(np.uint64)])
        if len(run) == chaining.K + chaining.SPAN - 1:
            assert np.isin(chaining.minimizers(other)[0], chaining.minimizers(shared)[0]).any()


def test_passages_odd(odd_docs, no_docs):
    rows = chaining.passages(odd_docs).collect()
    assert {(r.doc_id, r.rep_id) for r in rows} == {(6, 5)} and rows[0].n_words > 59_000
    assert chaining.passages(no_docs).count() == 0


