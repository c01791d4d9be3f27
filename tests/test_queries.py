"""Queries without SQL, against brute force on small tables."""

import pytest

from florilege import queries
from florilege.plans.answer import FOOTER, REFUSAL
from florilege.schema import AnswerOptions

#: One chunk each; the cuts at 220 and 400 bytes split characters of two, three and four bytes.
TEXTS = {
    1: "The greenhouse door must be closed at night. " + "Seedlings are moved outside in May. " * 14,
    2: "a" * 200 + "é" * 150,
    3: "b" * 201 + "é" * 150,
    4: "c" * 218 + "中" * 90,
    5: "d" * 219 + "中" * 90,
    6: "e" * 217 + "😀" * 60,
    7: "Die Tür des Gewächshauses muss nachts geschlossen sein.\n" + "Über Nacht wird es kühl, für Setzlinge zu kühl. " * 9,
    8: "La porte de la serre doit être fermée la nuit, sans délai.",
    9: "é" * 110,
    10: "",
}
#: The last is refused: no document has a word of it.
ASKED = {1: "When must the greenhouse door be closed?", 2: "Muss die Tür des Gewächshauses nachts geschlossen sein?", 3: "La porte de la serre doit être fermée la nuit?", 4: "zzzqqxx nonsense gibberish"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "s") for i, t in TEXTS.items()], "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(ASKED.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def cut(text, n):
    raw = text.encode()
    return raw[:n].decode(errors="replace") + "…" if len(raw) > n else text


def test_snippets_of_all_documents(spark, tables):
    got = {r.doc_id: r.snippet for r in queries.snippets(spark, tables).collect()}
    assert got == {i: cut(t, 220) for i, t in TEXTS.items()} and sum("�" in t for t in got.values()) >= 3


def test_sql_cuts_bytes_too(spark, tables):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tables}/documents.parquet/*.parquet'")
    assert dict(con.execute(queries.ORACLE_SQL["snippets"]).fetchall()) == {i: cut(t, 220) for i, t in TEXTS.items()}


def test_answers_to_all_questions(spark, tables, monkeypatch):
    hits, nl = {}, "\n"
    for r in sorted(queries.hybrid_topk(spark, tables).collect(), key=lambda r: r["rank"]):
        text = TEXTS[int(r.document_path.removeprefix("documents/").removesuffix(".txt"))].strip()
        hits.setdefault(r.query_id, []).append((r["rank"], r.document_path, text, f"{r.score:.3f}"))
    answers = {q: f"Based on {len(h)} matching passage(s) in your documents:\n\n" + "".join(f"{i}. ({p}) {cut(t, 400)}\n\n" for i, p, t, _ in h) + FOOTER for q, h in hits.items()} | {4: REFUSAL}
    foot = {q: "\nSources:\n" + "".join(f"  - {p} (score {s})\n" for _, p, _, s in h) for q, h in hits.items()} | {4: ""}
    sources = {q: "**Sources:**\n\n" + "".join(f"- `{p}` (score {s}): {cut(t, 220).replace(nl, ' ')}\n" for _, p, t, s in h) + "\n" for q, h in hits.items()} | {4: ""}
    run = lambda name: {r.query_id: r[1] for r in queries.QUERIES[name](spark, tables).collect()}
    assert run("extractive_answer") == answers
    monkeypatch.setattr(queries, "AnswerOptions", lambda threshold: AnswerOptions())  # the usual threshold, which the first three reach
    assert run("answer_text") == {q: f"{t}\n{foot[q]}" for q, t in answers.items()}
    assert run("session_sources") == {q: f"## Q{q}: {ASKED[q]}\n\n{t}\n\n{sources[q]}" for q, t in answers.items()}
    assert any("�" in t for t in answers.values())
    refused = {r.query_id: (r.refused, r.n_citations is None) for r in queries.answer_json(spark, tables).collect()}
    assert refused == {q: (t == REFUSAL, t == REFUSAL) for q, t in answers.items()}


def test_session_markdown_goes_through_the_operator(spark, tmp_path, monkeypatch):
    turns = [(7, 0, "user", "Wie spät?"), (7, 1, "assistant", "Acht."), (8, 0, "assistant", "Hello"), (8, 1, "user", "Bye?"), (8, 2, "assistant", "Bye."), (8, 3, "user", "And?")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    calls, real = [], queries.export.session_sections
    monkeypatch.setattr(queries.export, "session_sections", lambda *a: calls.append(a) or real(*a))
    got = sorted(map(tuple, queries.session_markdown(spark, str(tmp_path)).collect()))
    assert got == [(7, 0, "## Q0: Wie spät?\n\nAcht.\n\n"), (8, 1, "## Q1: Bye?\n\nBye.\n\n")] and len(calls) == 1
