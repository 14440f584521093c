"""Toxicity, language, HTML, WARC, mixing, packing and the pipeline: round trips, accuracy, brute force, odd cases."""

import base64
import collections
import hashlib
import io
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pipegrid.llm import htmltext, langid, mixing, packing, queries, toxicity, warc
from tests.conftest import SMALL
from tests.llm.conftest import DOCS, prose
from tools.check import TABLES, compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    assert compare(queries.QUERIES[name](spark, SMALL).toPandas(), con.execute(queries.ORACLES[name]).df()).startswith("ok")


# --- toxicity


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_params(1).items()}
    feats = toxicity.features(["ab", "hello", "wörld", "x", "bad"])
    ids = np.array([[0, 1, 2, 3, 4, 1, -1, -1] + [-1] * 24, [4, 4, 0, 1, 2, 3, 1, 0] * 4])
    target, weight = np.array([1.0, 0.0]), np.array([0.7, 0.3])
    _, g = toxicity.gradients(p, feats, ids, target, weight)
    for k in p:
        rows = g.get(f"{k} rows")
        for at in np.argwhere(np.abs(g[k]) > 1e-6)[rng.choice(20, 3) % max(1, (np.abs(g[k]) > 1e-6).sum())]:
            place = (rows[at[0]], *at[1:]) if rows is not None else tuple(at)
            kept, ends = p[k][place], []
            for step in (1e-3, -1e-3):
                p[k][place] = kept + step
                ends.append(toxicity.gradients(p, feats, ids, target, weight)[0])
            p[k][place] = kept
            assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(float(g[k][tuple(at)]), rel=1e-2, abs=1e-5)


def test_windows_cover_every_word():
    for n in (0, 1, 16, 31, 32, 33, 48, 49, 200):
        rows = toxicity.window_ids(np.arange(n))
        assert set(rows[rows >= 0]) == set(range(n))
        assert all(b[0] - a[0] == toxicity.STRIDE for a, b in zip(rows, rows[1:]))


@pytest.fixture(scope="module")
def toxic_table(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(260):
        words = prose(rng, rng.randint(20, 150)).split()
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zorkig", "zorkex", "zorkum"]))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out(spark, toxic_table, odd_docs, no_docs):
    docs, labels = toxic_table
    params = toxicity.train(docs, labels)
    rows = [r for r in toxicity.score(docs, params).collect()]
    assert {r.doc_id for r in rows if r.held_out} == {i for i in range(260) if zlib.crc32(str(i).encode()) % 4 == 2}
    wrong = [r for r in rows if r.held_out and r.predicted != (r.doc_id % 4 == 0)]
    assert len(wrong) <= 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    kept = toxicity.keep_clean(odd_docs, params)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id is null").count() == 2
    assert toxicity.score(odd_docs, params).count() == odd_docs.count()
    assert toxicity.score(no_docs, params).count() == 0
    assert toxicity.train(no_docs, labels) is None and toxicity.train(docs, labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score(odd_docs, None).collect()} == {0.0}


def test_a_hidden_window_decides(toxic_table):
    """A toxic word near the end of a long text is found; pieces change nothing."""
    docs, labels = toxic_table
    params = toxicity.train(docs, labels)
    clean = prose(random.Random(5), 40_000)
    low, high = toxicity.text_logits(params, [clean, clean + " zorkig zorkum " + clean[:50]])
    assert high > low


# --- language


def test_languages(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = langid.identify(docs, langid.train(docs)).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 0
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    odd = langid.identify(odd_docs, langid.train(docs)).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in odd if r.doc_id in (2, 3, 4, 7)} == {"und"}
    assert {r.lang_pred for r in langid.identify(odd_docs, langid.train(no_docs)).collect()} == {"und"}
    assert langid.identify(no_docs, langid.train(docs)).count() == 0


def test_profiles_equal_plain_binding():
    text = "ab c"
    kinds = langid._classes()
    rotated = langid._letters()
    padded = [0, 0, *[int(kinds[ord(c)]) for c in text], 0, 0]
    want = np.zeros(langid.DIM)
    for gram in zip(padded, padded[1:], padded[2:]):
        if any(gram):
            want += rotated[2][gram[0]].astype(int) * rotated[1][gram[1]] * rotated[0][gram[2]]
    assert np.array_equal(langid.profiles([text])[0], want)


# --- HTML


PAGES = [
    ("<article><h1>A &amp; B</h1><p>one  two\n three</p><p>Ti.</p></article><footer>&copy; me</footer>", "A & B\none two three\nTi."),
    (None, ""),
    ("", ""),
    ("<p>&lt;b&gt; &eacute; &#233; &#x1F600;</p>", "<b> é é \U0001f600"),
    ("<nav><a href=x>Home</a></nav><p>a <b>bold</b> word<br>next</p><script>var t='</p>';</script>", "a bold word next"),
    ("<div class='comments'><p>says a reader</p></div><div class='post-content'><p>The text of the page is here.</p></div>", "The text of the page is here."),
    ("<article><p>unclosed <p>second <div class='ad'>buy</div><p>third", "unclosed\nsecond\nthird"),
    ("<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>Body text.</p><aside>x</aside></main>", "Title\nBody text."),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, None, h) for i, (h, _) in enumerate(PAGES)] + [(None, "u", PAGES[0][0])], "page_id long, url string, html string")
    rows = htmltext.main_text(df.withColumn("text", F.lit("clash"))).collect()
    assert [r.text for r in sorted(rows, key=lambda r: (r.page_id is None, r.page_id))] == [*[t for _, t in PAGES], PAGES[0][1]]
    assert all(r.n_chars == len(r.text) for r in rows)
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_given_pages_keep_the_article(spark):
    import html
    import re

    for r in htmltext.main_text(spark.read.parquet(f"{SMALL}/pages.parquet")).join(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:h1|p)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    long = "x" * 3_000_000
    htmls = ["a", "b", "a", None, "", long, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nnot a record", "a", "é\r\n\r\n"]
    rows = [(i, f"http://e.org/{i} \n x", h) for i, h in enumerate(htmls)] + [(None, None, "a"), (None, None, "only here"), (2, None, "a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(df.withColumn("sha", F.lit("clash")), f"file:{tmp_path}/w").collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(ids, default=None)
        revisit = first is not None and i != first
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert warc.round_trip(df.limit(0), f"file:{tmp_path}/e").count() == 0


def test_members_can_be_read_alone():
    records = [warc.record(i, "u", bytes([65 + i]) * (10 ** (2 * i)), None) for i in range(4)]
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = whole.compress(b"".join(records[:2])) + whole.flush()
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    data += whole.compress(b"".join(records[2:])) + whole.flush()  # two members: still one stream of records
    sink = io.BytesIO()
    entries = list(warc.split_members(io.BytesIO(data), sink))
    made = sink.getvalue()
    assert [zlib.decompress(made[e["offset"] : e["offset"] + e["length"]], 31) for e in entries] == records
    with pytest.raises(EOFError):
        list(warc.split_members(io.BytesIO(data[: len(data) // 2]), io.BytesIO()))


# --- mixing


def test_schedule_stays_within_a_block(spark):
    weights = {"a": 5.0, "b": 3.0, "c": 1.5, "d": 0.01}
    rows = mixing.period_slots(mixing.quotas(spark.createDataFrame(list(weights.items()), "source string, weight double"), 400)).orderBy("slot").collect()
    quota = {r.source: r.quota for r in rows}
    assert [r.slot for r in rows] == list(range(400)) and sum(quota.values()) == 400
    had = collections.Counter()
    for r in rows:
        had[r.source] += 1
        assert all(abs(had[s] - quota[s] * (r.slot + 1) / 400) < 1 for s in quota)


def test_mixing_keeps_all_rows(spark, odd_docs, no_docs, make_docs):
    rows = mixing.schedule(odd_docs).collect()
    assert sorted(r.position for r in rows) == list(range(1, odd_docs.count() + 1))
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == odd_docs.count()
    assert mixing.schedule(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    docs = make_docs(["word " * 40] * 300)
    given = spark.createDataFrame([("s0", 2.0), ("s1", 1.0), ("s2", 0.0)], "source string, weight double")
    order = [r.source for r in sorted(mixing.schedule(docs, given, 200).collect(), key=lambda r: r.position)]
    assert all(abs(order[:n].count("s0") - 2 * n / 3) < 1.01 for n in range(150)) and set(order[-100:]) == {"s2"}
    assert [r.source for r in mixing.mix(docs, given, 200).select("source").collect()] == order


# --- packing


def best_fit_plainly(lengths, row):
    rows = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rows if row - sum(lengths[i] for i in r) >= lengths[item]]
        if fits:
            max(fits, key=lambda r: sum(lengths[i] for i in r)).append(item)
        else:
            rows.append([item])
    return rows


def test_best_fit_equals_plain_search():
    rng = random.Random(1)
    for _ in range(40):
        lengths = [rng.randint(1, 64) for _ in range(60)]
        got = packing.best_fit(lengths, 64)
        shape = lambda rows: sorted(sum(lengths[i] for i in r) for r in rows)  # noqa: E731  rows with equal room are alike
        assert sorted(i for r in got for i in r) == list(range(60)) and all(sum(lengths[i] for i in r) <= 64 for r in got)
        assert shape(got) == shape(best_fit_plainly(lengths, 64))


def unpacked(rows, row):
    parts = collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], np.uint16)
        ends = r["cu_seqlens"]
        assert len(ids) == row and ends[0] == 0 and ends[-1] == r["n_tokens"] and r["position_resets"] == ends[:-1]
        for doc, start, a, b in zip(r["doc_ids"], r["token_starts"], ends, ends[1:]):
            parts[doc].append((start, ids[a:b]))
    return parts


def test_packing_round_trip(spark, odd_docs, no_docs, make_docs, tmp_path):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 400)) for _ in range(60)] + ["", None, "<|endoftext|>", "é\U0001f600\n\n  x", prose(rng, 30_000)]
    packed = packing.pack(make_docs(texts).repartition(2), row=256, group_rows=8)
    rows = [r.asDict() for r in packed.collect()]
    for doc, parts in unpacked(rows, 256).items():
        tokens = np.concatenate([t for _, t in sorted(parts, key=lambda p: p[0])])
        assert tokens[-1] == packing.END and packing.encoder().decode(tokens[:-1].tolist()) == (texts[doc] or "")
    assert len(unpacked(rows, 256)) == len(texts)
    files = packing.write_matrices(packed, f"file:{tmp_path}/m").collect()
    assert sum(f.rows for f in files) == len(rows)
    for f in files:
        matrix, lines = packing.read_matrix(f"file:{tmp_path}/m", f.name, 256)
        assert len(matrix) == len(lines) == f.rows
    assert packing.pack(no_docs).count() == 0
    odd = packing.pack(odd_docs).collect()
    assert sum(len(r.doc_ids) for r in odd) >= odd_docs.count()


def test_pieces_tokenise_like_the_whole():
    text = prose(random.Random(3), 3_000) + "   \n 12 34 ... " + prose(random.Random(4), 2_000)
    encode = packing.encoder().encode_ordinary
    assert [t for p in packing.pieces(text, 500) for t in encode(p)] == encode(text)


# --- pipeline


def test_packing_follows_the_mixture(spark, make_docs, tmp_path):
    """Many uneven files, read in another order than they were written in, are packed in the order of the schedule."""
    docs = make_docs([(i, "word " * (200 + 37 * i % 2_000)) for i in range(900)])
    for at, end in ((0, 30), (30, 500), (500, 510), (510, 800), (800, 900)):
        part = mixing.mix(docs).filter((F.col("doc_id") >= at) & (F.col("doc_id") < end))
        part.repartition(1 + at % 7).write.mode("append").parquet(f"{tmp_path}/mixed")
    want = {r.doc_id: r.slot for r in mixing.schedule(docs).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sorted(corpus_pipeline.write_tokens(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect(), key=lambda r: (r.shard, r.seq))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(set(want.values())) > 20 and {d for r in rows for d in r.doc_ids} == set(want)
    assert all(s == want[d] for r in rows for d, s in zip(r.doc_ids, r.slots, strict=True))
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).extend(r.slots)
    assert all(max(a) <= min(b) for a, b in zip(list(shards.values()), list(shards.values())[1:])) and len(shards) > 1


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SMALL).cache()
        assert out.columns == docs.columns
        assert out.exceptAll(kept).isEmpty() and out.count() <= kept.count()
        if name == "mixing":
            assert out.count() == kept.count()
        kept = out
    assert 0 < kept.count() < docs.count()
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {d for r in packed for d in r.doc_ids} == {r.doc_id for r in kept.select("doc_id").collect()}
