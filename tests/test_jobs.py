"""The jobs over growing input, on copies."""

import hashlib
import json
import os
import subprocess
import sys

import pytest
import jobs.index_documents as job1
from jobs import config
from jobs.answer_questions import answer_questions, read_answers, read_citations

KIND = "doc_id long, text string, lang string, source string"
FIRST = [
    (1, "Trips must be approved by a manager before they are booked.", "en", "a"), (2, "Die Tür des Gewächshauses muss nachts geschlossen sein.", "de", "a"), (3, "old text of the third", "en", "b"),
    (4, "will be removed", "fr", "b"), (5, None, "en", "b"), (6, "twice the same", None, "c"), (6, "twice the same", None, "c"), (None, "no id", "en", "c"), (7, " \n", "en", "c"),
]
SECOND = [(3, "new text of the third", "en", "b"), (4, None, "fr", "b"), (1, FIRST[0][1], "en", "a"), (8, "ein achter Text", "de", "a"), (5, None, "en", "b"), (9, "one of two", "en", "a"), (9, "the other of two", "en", "a")]


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / n) for n in ("in", "index", "checkpoint")]


def put(spark, rows, folder):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(folder)


def state(spark, index):
    rows = job1.current_chunks(spark, index).collect()
    return {(r.document_path.split("/")[1][:-4], r.lang): r.text for r in rows}


AFTER_FIRST = {("1", "en"): FIRST[0][1], ("2", "de"): FIRST[1][1], ("3", "en"): FIRST[2][1], ("4", "fr"): "will be removed", ("6", "unknown"): "twice the same"}


def after_second():
    winner = max(("one of two", "the other of two"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    kept = {k: v for k, v in AFTER_FIRST.items() if k[0] not in "34"}
    return kept | {("3", "en"): "new text of the third", ("8", "de"): "ein achter Text", ("9", "en"): winner}


def test_two_runs_over_growing_input(spark, folders):
    source, index, checkpoint = folders
    put(spark, FIRST, source)
    assert job1.index_documents(spark, *folders) == len(FIRST)
    assert state(spark, index) == AFTER_FIRST
    put(spark, SECOND, source)
    assert job1.index_documents(spark, *folders) == len(SECOND)  # nothing of the first file again
    assert state(spark, index) == after_second()
    before = sorted(os.listdir(f"{index}/chunks"))
    assert job1.index_documents(spark, *folders) == 0
    assert state(spark, index) == after_second() and sorted(os.listdir(f"{index}/chunks")) == before
    # the unchanged document and the one that was never there are not written again
    assert spark.read.parquet(f"{index}/documents/batch=1").count() == 4
    # a fresh index over all files at once is the same: of each document the latest file counts
    late = max((f"{source}/{n}" for n in os.listdir(source) if n.endswith(".parquet")), key=lambda p: spark.read.parquet(p).where("doc_id = 8").count())
    os.utime(late, (4e9, 4e9))
    job1.index_documents(spark, source, index + "2", checkpoint + "2")
    assert state(spark, index + "2") == after_second()


def test_a_run_that_was_cut_off_is_repeated(spark, folders, monkeypatch):
    source, index, _ = folders
    put(spark, FIRST, source)
    job1.index_documents(spark, *folders)
    put(spark, SECOND, source)
    real = job1.term_statistics
    monkeypatch.setattr(job1, "term_statistics", lambda rows: 1 / 0)
    with pytest.raises(Exception, match="division by zero"):
        job1.index_documents(spark, *folders)
    assert state(spark, index) == AFTER_FIRST  # chunks of the broken batch lie there, but don't count
    monkeypatch.setattr(job1, "term_statistics", real)
    assert job1.index_documents(spark, *folders) == len(SECOND)
    assert state(spark, index) == after_second()


def test_few_and_many_ids_take_the_same_rows(spark, folders, monkeypatch):
    monkeypatch.setattr(job1, "BROADCAST_IDS", 0)
    put(spark, FIRST, folders[0])
    job1.index_documents(spark, *folders)
    put(spark, SECOND, folders[0])
    job1.index_documents(spark, *folders)
    assert state(spark, folders[1]) == after_second()


def test_terms_add_up_to_document_frequencies(spark, folders):
    put(spark, FIRST[:3], folders[0])
    job1.index_documents(spark, *folders)
    got = {r.term: r.df for r in spark.read.parquet(f"{folders[1]}/terms").collect()}
    assert got["must"] == 1 and got["text"] == 1 and got["of"] == 1 and got["muss"] == 1


def test_an_empty_table_and_a_remote_one(spark, tmp_path, folders):
    source, index, checkpoint = folders
    spark.createDataFrame([], KIND).write.parquet(source)
    assert job1.index_documents(spark, *folders) == 0
    put(spark, FIRST, source)
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.jobs.link./in", f"file://{tmp_path}")
    try:
        assert job1.index_documents(spark, "viewfs://jobs/in/in", "viewfs://jobs/in/far", checkpoint + "2") == len(FIRST)
        assert state(spark, "viewfs://jobs/in/far") == AFTER_FIRST
    finally:
        conf.unset("fs.viewfs.mounttable.jobs.link./in")


def test_other_tables_are_named(spark, folders):
    spark.range(3).write.parquet(folders[0])
    with pytest.raises(ValueError, match="no column doc_id"):
        job1.index_documents(spark, *folders)


@pytest.fixture
def asked(spark, tmp_path, folders):
    put(spark, FIRST, folders[0])
    job1.index_documents(spark, *folders)
    rows = [(1, "Who approves trips before they are booked?", 0), (2, "Muss die Tür des Gewächshauses nachts geschlossen sein?", 0), (3, "zzzqqxx gibberish", 0), (4, None, 0), (2, "Muss die Tür des Gewächshauses nachts geschlossen sein?", 0), (None, "no id", 0)]
    path = str(tmp_path / "questions")
    spark.createDataFrame(rows, "item_id int, text string, score int").write.parquet(path)
    return path


def test_answers_and_reruns(spark, folders, asked, tmp_path):
    target = str(tmp_path / "answers")
    everything = lambda: (sorted(map(tuple, read_answers(spark, target).collect())), sorted(map(tuple, read_citations(spark, target).drop("score").collect())))
    answer_questions(spark, folders[1], asked, target, {"top_k": 2})
    first = everything()
    assert {(a[0], a[6]) for a in first[0]} == {(1, True), (2, True), (3, False), (4, False)}
    best = read_citations(spark, target).where("rank = 1").collect()
    assert {(r.query_id, r.document_path, r.lang) for r in best} == {(1, "documents/1.txt", "en"), (2, "documents/2.txt", "de")}
    answer_questions(spark, folders[1], asked, target, {"top_k": 2})
    assert everything() == first
    answer_questions(spark, folders[1], asked, target, {"top_k": 2, "threshold": 2.0, "run": "strict"})
    assert read_answers(spark, target).where("run = 'strict' and answerable").count() == 0
    assert read_answers(spark, target).where("run = 'latest'").count() == 4
    coverage = {r.lang: (r.documents, r.questions) for r in spark.read.parquet(f"{target}/coverage").where("run = 'latest'").collect()}
    assert coverage["de"][0] == 1 and coverage["de"][1] >= 1 and coverage["fr"][0] == 1
    answer_questions(spark, folders[1], asked, target, {"top_k": 2, "threshold": 2.0})  # fewer partitions than before: none is left
    assert read_answers(spark, target).where("run = 'latest' and answerable").count() == 0
    with pytest.raises(ValueError, match="can't name"):
        answer_questions(spark, folders[1], asked, target, {"run": "a/b"})


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"top_k": 3,\n "threshold": 1}')
    assert config.load(spark, str(tmp_path / "c.json"), {"top_k": 5, "threshold": 0.1, "run": "x"}) == {"top_k": 3, "threshold": 1, "run": "x"}
    for text, said in (('{"k": 3}', "unknown keys"), ('{"top_k": "3"}', "must be like 5")):
        (tmp_path / "c.json").write_text(text)
        with pytest.raises(ValueError, match=said):
            config.load(spark, str(tmp_path / "c.json"), {"top_k": 5})
    root = os.path.dirname(os.path.dirname(os.path.abspath(config.__file__)))
    for name, module in (("index_documents", job1), ("answer_questions", sys.modules["jobs.answer_questions"])):
        with open(f"{root}/jobs/{name}.json") as f:
            assert json.load(f) == module.DEFAULTS


def test_command_lines(spark, folders, asked, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(config.__file__)))
    put(spark, SECOND, folders[0])
    run = lambda *args: subprocess.run([sys.executable, "-m", *args], cwd=root, capture_output=True, text=True, timeout=300)
    done = run("jobs.index_documents", "--source", folders[0], "--target", folders[1], "--checkpoint", folders[2], "--config", "jobs/index_documents.json")
    assert done.returncode == 0 and f"{len(SECOND)} rows read" in done.stderr, done.stderr[-2000:]
    assert state(spark, folders[1]) == after_second()
    done = run("jobs.answer_questions", "--index", folders[1], "--questions", asked, "--target", str(tmp_path / "out"))
    assert done.returncode == 0 and "read 4 questions" in done.stderr, done.stderr[-2000:]
    assert read_answers(spark, str(tmp_path / "out")).count() == 4
