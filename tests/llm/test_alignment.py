import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pipegrid.llm import alignment
from tests.llm.conftest import prose

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain_tokens(texts):
    """The contract's tokens by the libraries themselves, on whole texts: (ids, byte strings) of both sides."""
    import json
    import re

    import sentencepiece
    from tokenizers import Tokenizer

    folder = alignment.VOCABULARIES
    a = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    entries = {i: bytes(letters[c] for c in x) for x, i in json.load(open(f"{folder}/byte_bpe_50k.json"))["model"]["vocab"].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")

    def piece(i):
        found = re.fullmatch("<0x(..)>", b.id_to_piece(i))
        return bytes([int(found[1], 16)]) if found else b.id_to_piece(i).replace("▁", " ").encode()

    out = []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        sides = [(i, entries[i]) for i in ids_a], [(i, piece(i)) for i in ids_b]
        whole = (" " + (text or "")).encode()
        out.append(sides if all(b"".join(x for _, x in s) == whole for s in sides) else ([], []))
    return out


def plain(texts):
    """All of the contract, token by token."""
    rows, counts = [], Counter()
    for a, b in plain_tokens(texts):
        spans = []
        for side in (a, b):
            at, found = 0, []
            for i, x in side:
                found.append((i, at, at + len(x)))
                at += len(x)
            spans.append(found)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = [[[str(i) for i, s, e in side if start <= s and e <= end] for side in spans] for start, end in zip([0, *ends], ends)]
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        counts.update(set(links))
        text = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    highest = Counter()
    for (i, _), n in counts.items():
        highest[i] = max(highest[i], n)
    return [(a, b, g, len(x), sum(counts[p] == highest[p[0]] for p in x), sum(counts[p] for p in x), sha) for a, b, g, x, sha in rows]


def found(docs):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs).collect()}


ODD = ["", " ", "\n", " \t a", "x▁y", "a ▁", "<|endoftext|> <s> </s> <unk> <0x41>", "a b 　c", "\x00 \x1c \x85", "é ﬁ Å", "a  b   c\n\n  d\r\n e ", "don't we'll  'tis",
       "\U0001f600\U0001f468‍\U0001f469 x", "1234567 12,5 %%% ||| ...", "!\x1c !\t !", "  lead", "trail  ", "word\n", "“quoted” text… über straße", "a" * 300, "� "]


def test_equals_plain_alignment(make_docs, monkeypatch):
    rng = random.Random(2)
    texts = [None, *ODD, *(prose(rng, rng.randrange(1, 60)) for _ in range(20)), "\n".join(prose(rng, 9) for _ in range(9))]
    texts += texts[-5:]
    assert found(make_docs(texts)) == dict(enumerate(plain(texts)))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=40))
def test_stretches_encode_like_whole_texts(texts):
    pair = alignment.pair_of(alignment.VOCABULARIES)
    got = [tuple(x.tolist() for x in sides) for sides in pair.encode(texts)]
    assert got == [tuple([i for i, _ in side] for side in sides) for sides in plain_tokens(texts)]


def test_stretches_of_odd_white_space():
    rng = random.Random(8)
    pair = alignment.pair_of(alignment.VOCABULARIES)
    parts = [" ", " ", "  ", "\n", "\t", "\x1c", " ", "　", "a", "'s", "Bc", "!", "9", "́", "▁", "\r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    got = [tuple(x.tolist() for x in sides) for sides in pair.encode(texts)]
    assert got == [tuple([i for i, _ in side] for side in sides) for sides in plain_tokens(texts)]


def test_gallop_equals_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(300):
        longer, shorter = (np.unique(rng.integers(0, rng.choice([20, 2000, 10**9]), rng.integers(0, 400))) for _ in "ab")
        assert (alignment.ranks(longer, shorter) == np.searchsorted(longer, shorter)).all()


def test_memory_of_stretches_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 30)
    pair = alignment.Pair(alignment.VOCABULARIES)
    rng = random.Random(4)
    texts = [prose(rng, 12) for _ in range(40)]
    got = [tuple(x.tolist() for x in pair.encode([t])[0]) for t in texts]
    assert got == [tuple([i for i, _ in side] for side in sides) for sides in plain_tokens(texts)] and len(pair.kept) <= 60


@pytest.mark.parametrize("links, chars, hot", [(1, 1, 4), (300, 500, 1), (1 << 20, 1 << 21, 1 << 16)])
def test_chunks_give_the_same_result(spark, make_docs, monkeypatch, links, chars, hot):
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(0, 40)) or None for _ in range(30)] * 2
    monkeypatch.setattr(alignment, "HOT", hot)
    docs = make_docs(texts)
    run = alignment._aligned(alignment.VOCABULARIES)

    def small(batches):
        alignment.LINKS, alignment.CHARS = links, chars
        try:
            yield from run(batches)
        finally:
            alignment.LINKS, alignment.CHARS = 1 << 20, 1 << 21

    monkeypatch.setattr(alignment, "_aligned", lambda folder: small)
    assert found(docs) == dict(enumerate(plain(texts)))


def test_odd_rows(odd_docs, no_docs):
    rows = alignment.align(odd_docs).collect()
    assert len(rows) == odd_docs.count() and sum(r.doc_id is None for r in rows) == 2
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].n_a == 0 and by_id[2].groups_sha256 == "" and by_id[5].n_links >= by_id[5].n_a >= 60_000
    assert alignment.align(no_docs).count() == 0
