"""Chunks by ranges against those of whole texts."""

import random

import pytest

from florilege.operators.chunk import chunk_documents
from florilege.operators.chunk_ranges import chunk_all, chunk_by_ranges
from florilege.schema import ChunkOptions

rng = random.Random(21)
TEXTS = ["", " ", "word", " \n lead and trail \t ", "x" * 50 + " y " + "z" * 90, "\u00a0 \u2003 \u00a0 " * 30, "é中😀 " * 40, "a\u2003b " * 3 + "\u2003 " * 60 + "c d", None]
TEXTS += ["".join(rng.choice(["a", "bc", "é", "😀", " ", " ", "\n", "\u2003", "longer_word"]) for _ in range(rng.randrange(300))) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(f"d{k}", f"{k}.txt", t, [20, 60] if k % 2 else None) for k, t in enumerate(TEXTS)], "id string, path string, text string, boundaries array<long>")


def rows(frame):
    return sorted((r.document_id, r.start_offset, r.end_offset, r.id, r.document_path, r.text, r.page_number, tuple(r.embedding), r.dl, tuple(sorted((t.term, t.tf) for t in r.terms))) for r in frame.collect())


@pytest.mark.parametrize(("size", "overlap", "chars"), [(5, 2, 1), (5, 2, 7), (4, 0, 10), (3, -2, 6), (220, 40, 33), (1, 0, 16), (6, 5, 1000)])
def test_ranges_of_any_length_give_the_same_chunks(docs, size, overlap, chars):
    options = ChunkOptions(size, overlap)
    assert rows(chunk_by_ranges(docs, options, 16, chars=chars)) == rows(chunk_documents(docs, options, 16))


def test_long_documents_alone_are_cut(docs):
    options = ChunkOptions(5, 2)
    want = rows(chunk_documents(docs, options, 16))
    for long_bytes in (0, 100, 10_000_000):
        assert rows(chunk_all(docs, options, 16, long_bytes=long_bytes)) == want
