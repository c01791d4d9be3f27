import json

import pytest
from pyspark.sql import functions as F

from florilege.functions import scores, text
from florilege.operators.chunk import chunk_documents, embed_texts, reembed
from florilege.operators.fusion import hybrid_search
from florilege.operators.keyword import KeywordIndex, bm25_scores, corpus_stats
from florilege.operators.vector import VectorIndex, confidence, cosine_top_k
from florilege.plans import export
from florilege.plans.answer import NO_CONTEXT, REFUSAL, Called, answer, extractive_text, prompt, remote
from florilege.schema import AnswerOptions, ChunkOptions

CORPUS = {
    "garden.md": "Water the tomatoes every second morning. The greenhouse door must be closed at night, and seedlings are moved outside in May.",
    "billing.md": "Invoices are sent on the first of the month. A late invoice costs ten percent. Refunds go through the billing portal.",
    "release.md": "A release needs two approvals. Tag the commit, run the smoke tests and announce the release in the team channel.",
    "alarm.md": "If the alarm rings, leave the building, call the fire line and wait at the meeting point until the warden counts everybody.",
}


@pytest.fixture(scope="module")
def chunks(spark):
    docs = spark.createDataFrame([(k, k, v) for k, v in CORPUS.items()], "id string, path string, text string")
    return chunk_documents(docs, ChunkOptions(100, 0)).persist()


def ask(spark, *texts, top_k=0):
    return spark.createDataFrame([(i, t, top_k) for i, t in enumerate(texts)], "query_id long, text string, top_k int")


@pytest.mark.parametrize(("question", "path"), [("When is the greenhouse door closed?", "garden.md"), ("What does a late invoice cost?", "billing.md"), ("How many approvals does a release need?", "release.md"), ("What to do if the alarm rings?", "alarm.md")])
def test_right_document_in_the_top_three(spark, chunks, question, path):
    found = hybrid_search(chunks, ask(spark, question), 3).join(chunks.select(F.col("id").alias("chunk_id"), "document_path"), "chunk_id").orderBy("rank").collect()
    assert path in [r.document_path for r in found[:3]] and [r["rank"] for r in found] == [1, 2, 3]


def test_search_without_lexical_match_still_gives_rows(spark, chunks):
    assert hybrid_search(chunks, ask(spark, "zzz qqq"), 2).count() == 2
    assert hybrid_search(chunks, ask(spark, "?!"), 2).count() == 2
    with pytest.raises(ValueError):
        hybrid_search(chunks, ask(spark, "x"), -1)


def test_guardrail(spark, chunks):
    rows = {r.query_id: r for r in answer(chunks, ask(spark, "zzzqqxx nonsense gibberish", "When is the greenhouse door closed at night?")).collect()}
    assert not rows[0].answerable and rows[0].text == REFUSAL and rows[0].citations is None
    assert rows[1].answerable and rows[1].citations[0].document_path == "garden.md" and rows[1].text.startswith("Based on 4 matching passage(s)")
    assert rows[1].confidence >= AnswerOptions.threshold > rows[0].confidence


def test_per_question_top_k_and_generator(spark, chunks):
    called = Called(lambda q, passages: f"{q}|{len(passages)}|{passages[0][0]}")
    row = answer(chunks, ask(spark, "When is the greenhouse door closed at night?", top_k=2), generator=called).first()
    assert row.text == "When is the greenhouse door closed at night?|2|garden.md" and len(row.citations) == 2
    with pytest.raises(ValueError):
        answer(chunks, ask(spark, "x", top_k=-2))


def test_empty_index(spark, chunks):
    empty = chunks.limit(0)
    row = answer(empty, ask(spark, "anything")).first()
    assert (row.answerable, row.confidence) == (False, 0.0)
    assert corpus_stats(empty).first().n == 0 and bm25_scores(empty, ask(spark, "x")).count() == 0


def test_zero_vector_and_cosine(spark):
    vectors = embed_texts(spark.createDataFrame([(1, "..."), (2, "a b a")], "query_id long, text string"), "query_id").collect()
    by = {r.query_id: r.embedding for r in vectors}
    assert set(by[1]) == {0.0} and abs(sum(x * x for x in by[2]) - 1) < 1e-5
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0])], ["a", "b", "z", "s"]).select(*(scores.cosine(F.col("a"), F.col(c)) for c in ("b", "z", "s", "a"))).first()
    assert [round(x, 6) for x in row] == [0.707107, 0.0, 0.0, 1.0]


@pytest.mark.parametrize("blocks", [(4096, 16_384, 512), (4096, 16_384, 7), (2, 40, 16)])
def test_vector_top_k_against_brute_force(spark, monkeypatch, blocks):
    import numpy as np

    from florilege.operators import vector

    for name, size in zip(("QUESTION_BLOCK", "CHUNK_BLOCK", "_SLICE"), blocks, strict=True):
        monkeypatch.setattr(vector, name, size)

    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 8)), 1)
    x[7] = 0
    rows = spark.createDataFrame([(f"{i:03}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in (0, 3, 7)], "query_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in cosine_top_k(rows, asked, 12).collect()}
    norm = np.linalg.norm(x, axis=1)
    for q in (0, 3, 7):
        with np.errstate(all="ignore"):
            s = np.nan_to_num(x @ x[q] / (norm * norm[q]), nan=0.0)
        want = sorted(range(300), key=lambda i: (-round(s[i], 9), i))[:12]
        assert [got[q, k + 1] for k in range(12)] == [f"{i:03}" for i in want]


def test_many_terms_give_the_same_scores(spark, chunks, monkeypatch):
    from florilege.operators import keyword

    asked = spark.createDataFrame([(1, "when does the alarm ring"), (2, "the door of the greenhouse, the the")], "query_id long, text string")
    few = {(r.query_id, r.chunk_id): r.score for r in bm25_scores(chunks, asked).collect()}
    monkeypatch.setattr(keyword, "BROADCAST_TERMS", 0)
    many = {(r.query_id, r.chunk_id): r.score for r in bm25_scores(chunks, asked).collect()}
    assert few and few == pytest.approx(many)


def test_some_columns_of_chunks(spark):
    docs = spark.createDataFrame([("d", "p", "a b a c " * 90), ("e", "q", None), ("f", "r", " \u00a0 ")], "id string, path string, text string")
    whole = {r.id: r for r in chunk_documents(docs, ChunkOptions(50, 10)).collect()}
    assert len(whole) > 2 and all({t.term: t.tf for t in r.terms} == {x: r.text.split().count(x) for x in r.text.split()} and r.dl == len(r.text.split()) for r in whole.values())
    for columns in (["dl"], ["id", "terms"], ["embedding", "id"], ["text", "page_number", "id"]):
        some = chunk_documents(docs, ChunkOptions(50, 10), columns=columns)
        assert some.columns == columns and some.count() == len(whole)
        if "id" in columns:
            assert all(r[c] == whole[r.id][c] for r in some.collect() for c in columns)


def test_index_add_and_remove(spark, chunks):
    gone = chunks.where("document_path = 'alarm.md'").select("id")
    less = KeywordIndex(chunks).remove(gone)
    assert corpus_stats(less.chunks).first().n == 3
    again = less.add(chunks)  # known ids are replaced, not counted twice
    assert corpus_stats(again.chunks).first().asDict() == corpus_stats(chunks).first().asDict()
    assert VectorIndex(chunks).remove(gone).search(ask(spark, "alarm"), 9).count() == 3
    assert VectorIndex(chunks).remove(gone).add(chunks).search(ask(spark, "alarm"), 9).count() == 4


def test_reembedding(spark, chunks):
    assert {len(r.embedding) for r in reembed(chunks, 16).collect()} == {16}
    assert confidence(chunks, embed_texts(ask(spark, "alarm rings"), "query_id")).first().confidence > 0.1


def test_extractive_text(spark):
    rows = spark.createDataFrame([([("p", "x" * 401)],), ([],)], "passages array<struct<path:string,text:string>>").select(extractive_text(F.col("passages")).alias("t")).collect()
    assert "1. (p) " + "x" * 400 + "…\n\n" in rows[0].t and rows[1].t == NO_CONTEXT
    assert prompt("q", [("p", "t"), ("r", "u")]) == "Sources:\n\n[1] Source: p\nt\n\n[2] Source: r\nu\n\n\nQuestion: q"
    assert remote("http://127.0.0.1:9/none", "key", "model").fn("q", []) == NO_CONTEXT  # nothing is sent


def test_renderings(spark, chunks):
    found = answer(chunks, ask(spark, "zzzqqxx nonsense gibberish", "When is the greenhouse door closed at night?")).persist()
    texts = {r.query_id: json.loads(r.json) for r in export.answer_json(found).collect()}
    assert texts[0]["citations"] is None and list(texts[1]) == ["text", "citations", "confidence", "answerable"]
    plain = {r.query_id: r.rendered for r in export.answer_text(found).collect()}
    assert "Sources" not in plain[0] and "\nSources:\n  - garden.md (score 0.033)\n" in plain[1]
    session = export.session_markdown(found.withColumn("seq", F.col("query_id") + 1), "notes", "2024-01-01T00:00:00Z")
    assert session.startswith("# Session — notes\n\n_Exported 2024-01-01T00:00:00Z_\n\n## Q1: zzz") and session.count("**Sources:**") == 1 and "- `garden.md` (score 0.033): Water" in session


def test_page_numbers_and_ids(spark):
    docs = spark.createDataFrame([("d1", "p", "a b c d e f", [4, 8])], "id string, path string, text string, boundaries array<long>")
    rows = chunk_documents(docs, ChunkOptions(2, 0)).orderBy("start_offset").collect()
    assert [r.page_number for r in rows] == [1, 2, 3] and [r.id for r in rows] == ["b981c0d11db5cf58", "aec0f4cdfadf6a20", "561170ceda2fe505"]
    assert text.CODE_MIME
