import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pipegrid.llm import lines
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    """The contract's counts, window by window."""
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    spoken = [x for x in text.split("\n") if WORD.search(x)]
    n, repeated = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(spoken) - len(set(spoken)), repeated, n < 20 or 100 * repeated > 30 * n


def found(docs):
    rows = lines.report(docs).collect()
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}


def test_counts_equal_plain_ones(make_docs):
    rng = random.Random(3)
    few = ["a", "b", "𝔘", "x|", "#", "é"]
    texts = [None, "", " \n\t", "one", "\x0b\x0c\r"]
    texts += ["".join(rng.choice([*few, " ", " ", "\n", "\t", " "]) for _ in range(rng.randrange(400))) for _ in range(60)]
    texts += [" ".join(rng.choice("ab") for _ in range(n)) for n in (7, 8, 9, 15, 16, 40, 300)]
    block = prose(rng, 30)
    texts += [block + "\n" + block, block * 3, prose(rng, 500) + block + prose(rng, 100) + " " + block, prose(rng, 20_000)]
    assert found(make_docs(texts)) == {i: plain_counts(t) for i, t in enumerate(texts)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t|#é "), max_size=120), min_size=1, max_size=8))
def test_counts_of_any_text(make_docs, texts):
    assert found(make_docs(texts)) == {i: plain_counts(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    "line, rule",
    [
        ("Home | Products | About us | Contact", "navigation"),
        ("Start > Shop > Books", "navigation"),
        ("WIN!! BIG!! MONEY!! NOW!! TODAY AND EVER.", "noise"),
        ("the%%% old&&& house### stood$$$ there on its own for years.", "noise"),
        ("Related articles", "unfinished"),
        ("© 2024 Example. All rights reserved.", "boilerplate"),
        ("We use cookies to improve your visit.", "boilerplate"),
        ("It rained.", None),
        ('She said "no."', None),
        ("a line of plain prose that was cut off at the end of the", None),
        ("He paid $$ 30 for it, and then another sum for the boat, which sank.", None),
        ("The copyrighted " + "story of a long court case " * 12 + "went on.", None),
        ("  \t ", None),
        ("", None),
    ],
)
def test_line_rules(spark, line, rule):
    assert spark.createDataFrame([(line,)], "x string").select(lines.line_verdict(F.col("x"))).first()[0] == rule


def test_failing_lines_go_and_heavy_losers_too(make_docs):
    rng = random.Random(9)
    body = "\n".join(prose(rng, 30) + "." for _ in range(4))
    menu = "Home | News | Sport | Contact"
    spam = "\n".join("!! ".join(prose(rng, 30).split()) + "!!" for _ in range(5))
    docs = make_docs([f"{menu}\n{body}\n\nAll rights reserved.", f"{body}\n{spam}", body, "too short.", None])
    rows = {r.doc_id: r for r in lines.clean(docs).collect()}
    assert [rows[i].kept for i in range(5)] == [True, False, True, False, False]
    assert rows[0].cleaned == body + "\n" and rows[0].failed_rules == {"navigation": 1, "noise": 0, "unfinished": 0, "boilerplate": 1}
    assert rows[0].lost_words == 10 and rows[1].failed_rules["noise"] == 5
    kept = lines.keep_good(docs).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept) == [(0, body + "\n", len(body) + 1), (2, body, len(body))]


def test_odd_rows(odd_docs, no_docs):
    out = lines.clean(odd_docs.withColumn("kept", F.lit("clash")))
    assert out.count() == odd_docs.count() and dict(out.dtypes)["kept"] == "boolean" and "Source2" in out.columns
    rows = {r.doc_id: r for r in lines.report(odd_docs).collect()}
    assert not rows[2].kept and rows[2].n_words == 0 and rows[5].kept and rows[5].n_words == 60_000
    assert lines.report(no_docs).count() == 0 and lines.keep_good(no_docs).columns == no_docs.columns
    assert lines.keep_good(odd_docs).columns == odd_docs.columns


def test_plan_is_native_and_moves_nothing(spark, odd_docs):
    plan = lines.report(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
