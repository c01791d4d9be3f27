"""Ranked lexical search against a plain version in Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from florilege.llm import lexical
from florilege.llm.lexical import Dictionary, Product, Terms, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, k=20):
    kept = [(i, Counter(t), len(t)) for i, t in ((i, terms(text)) for i, text in docs) if t]
    n_docs, total = len(kept), sum(n for *_, n in kept)
    df = Counter(t for _, c, _ in kept for t in c)
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(text))
    out = []
    for i, c in asked.items():
        scored = []
        for d, tf, n in kept:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(f * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, f in c.items() if tf[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def tables(n=300, seed=3):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "delta9", "Straße", "中文", "é", "ÀB", "x", "the", "of"] + [f"w{k}" for k in range(60)]
    weights = [1] * 9 + [30, 30] + [2] * 60
    text = lambda m: "".join(w + rng.choice([" ", ", ", "-", "\n", "_", "\u007f"]) for w in rng.choices(words, weights, k=rng.randrange(m)))
    docs = [(k, text(40)) for k in range(n)] + [(n, "beta gamma " * 5_000), (n + 1, None), (n + 2, ""), (n + 3, "--- ..."), (None, "beta beta alpha"), (5, "beta"), (5, "beta"), (n + 4, "only here"), (n + 5, "The OF")]
    docs += [(n + 10 + k, docs[0][1]) for k in range(40)]  # more ties than are kept
    items = [(k, text(12)) for k in range(25)] + [(30, docs[0][1]), (31, None), (32, ""), (33, "unheard"), (None, "beta"), (34, "beta beta"), (34, "gamma"), (35, "only")]
    return docs, items


@pytest.fixture(scope="module")
def frames(spark):
    docs, items = tables()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, score int")
    return docs, items, d, spark.createDataFrame([(i, t, 7) for i, t in items], "item_id int, text string, doc_id long")


def rows(found):
    return sorted(map(tuple, found.collect()), key=repr)


def test_search_equals_the_plain_version(frames):
    docs, items, d, i = frames
    assert rows(search(d, i)) == plain(docs, items)
    assert rows(search(d, i, 3)) == plain(docs, items, 3)


def test_many_blocks_and_equal_hashes_change_nothing(frames, monkeypatch):
    docs, items, d, i = frames
    monkeypatch.setattr(lexical, "ITEM_BYTES", 4_000)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 7)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 20)
    assert rows(search(d.repartition(5), i)) == plain(docs, items)


def test_terms_with_equal_hashes_are_told_apart(monkeypatch):
    real = lexical.segment_hashes
    monkeypatch.setattr(lexical, "segment_hashes", lambda *a: real(*a) % np.uint64(3))
    found = Terms.of(pa.array(["b aa c", None, "", "zz b", "D"]))
    where, number = Dictionary([b"aa", b"b", b"d", b"e", b"ee"]).find(found)
    got = [(found.bytes()[w], n) for w, n in zip(where.tolist(), number.tolist())]
    assert got == [(b"b", 1), (b"aa", 0), (b"b", 1), (b"d", 2)]
    assert found.first.tolist() == [0, 3, 3, 3, 5, 6]


def test_terms_are_the_pattern_s():
    rng = random.Random(8)
    texts = ["".join(rng.choice("aZ09 -_\n\u007f\u0080é中😀@[`{") for _ in range(rng.randrange(12))) for _ in range(500)]
    found = Terms.of(pa.array(texts))
    got = found.bytes()
    assert [got[a:b] for a, b in zip(found.first, found.first[1:])] == [[t.encode() for t in terms(x)] for x in texts]


def test_block_wise_top_k_keeps_ties_by_id():
    rng = np.random.default_rng(4)
    ids, scores = rng.permutation(500), rng.integers(0, 6, 500)
    p = Product([(np.zeros(1, np.int64), np.ones(1, np.int64))], np.ones(1, np.int64), 1, 1, 20)
    for low in range(0, 500, 33):
        p._keep(0, ids[low : low + 33], scores[low : low + 33])
    want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if s > 0)[:20]
    assert [(-s, i) for i, s in zip(*(x.tolist() for x in p.best[0]))] == want


def test_empty_tables_have_no_rows(frames):
    _, _, d, i = frames
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.where("text is null"), i)):
        assert search(a, b).count() == 0
