"""Kernels over many texts at a time, against plain versions of one text, and queries that need no shuffle."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from florilege import queries
from florilege.functions import kernels

rng = random.Random(5)
PARTS = ["a", "B", "c9", "_", "İ", "K", "é", "中", "😀", " ", " ", "\n", "\t", ".", "-", "longer_word", "\x0b", "É", "“"]
TEXTS = ["", "  ", "word", "İ", "K", "“x”", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(200))) for _ in range(100))]


def vector(tokens, dim):
    feats = tokens + [a + b"_" + b for a, b in zip(tokens, tokens[1:], strict=False)]
    count = np.bincount(kernels.fnv1a(feats) % dim, minlength=dim)
    weight = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0)
    norm = np.add.accumulate(weight * weight)[-1]
    return weight.astype(np.float32) * np.float32(1 / np.sqrt(norm)) if norm else weight.astype(np.float32)


@pytest.mark.parametrize(("size", "step"), [(5, 3), (4, 4), (3, 5), (220, 180), (1, 1)])
def test_many_texts_at_once_give_the_rows_of_each(size, step):
    raw, begin, _ = kernels.joined([t.encode() for t in TEXTS])
    text, start, end = kernels.cut(raw, begin, size, step)
    found = kernels.Indexed(raw, start, end)
    vectors, terms, got = found.vectors(64), found.terms().to_pylist(), {}
    for k, (own, a, b) in enumerate(zip(text, start, end, strict=True)):
        part = raw[a:b].decode().strip(kernels.WHITE_SPACE)
        tokens = kernels.tokens(part)
        assert found.n[k] == len(tokens) and (vectors[k] == vector(tokens, 64)).all()
        assert {t["term"].encode(): t["tf"] for t in terms[k]} == Counter(tokens)
        if part:
            got.setdefault(int(own), []).append((a - begin[own], b - begin[own], part))
    assert got == {i: w for i, t in enumerate(TEXTS) if (w := kernels.windows(t, size, step))}


@pytest.mark.parametrize("name", ["bucket_counts", "feature_weights"])
def test_features_are_counted_where_chunks_are(spark, tmp_path, name):
    spark.createDataFrame([(1, "one two one two", "s"), (2, "", "s"), (3, "...", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES[name](spark, str(tmp_path))
    assert "hashpartitioning" not in found._jdf.queryExecution().toString()
    rows = found.collect()
    assert sum(r.n for r in rows) == 7 if name == "bucket_counts" else len(rows) == 1


def test_words_are_hashed_where_they_are():
    """Many different words: none of them becomes a Python object before it is hashed."""

    class Buffers:
        """An Arrow array that only shows its buffers."""

        def __init__(self, strings):
            self.buffers, self.offset, self.n = strings.buffers, strings.offset, len(strings)

        def __len__(self):
            return self.n

    raw, begin, end = kernels.joined([t.encode() for t in TEXTS])
    found = kernels.Indexed(raw, begin, end)
    want = found.counts(64)
    found.words = Buffers(found.words)
    assert (found.counts(64) == want).all()
    words = pa.array([b"ab", b"", b"cde", b"f"], pa.binary())
    for part in (words, words.slice(1, 2), words.slice(4)):
        data, start, length = kernels.stretches(part)
        assert [data[a : a + n].tobytes() for a, n in zip(start, length, strict=True)] == part.to_pylist()
