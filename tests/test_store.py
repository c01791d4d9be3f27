"""The collection store with several writers, and its inverted index against a recount."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from florilege.operators import inverted
from florilege.operators.chunk import chunk_documents
from florilege.operators.keyword import KeywordIndex, corpus_stats, document_frequency
from florilege.schema import CHUNKS, ChunkOptions
from florilege.sources.store import Collection, CollectionStore, Delta

NAME = "c"


def delta(spark, texts, removed=()):
    """A segment of documents by id, and ids to remove."""
    docs = spark.createDataFrame([(i, f"{i}.txt", t) for i, t in texts.items()], "id string, path string, text string")
    documents = docs.select("id", "path", F.sha2("text", 256).alias("hash"), F.lit("text/plain").alias("mime_type"), F.lit(None).cast("timestamp").alias("indexed_at"))
    gone = spark.createDataFrame([(i,) for i in removed], "id string")
    return Delta(documents, chunk_documents(docs, ChunkOptions(8, 2)), gone)


def begin(spark, store, texts):
    d = delta(spark, texts)
    new = Collection.new(spark, NAME, "root")
    return store.save(Collection(new.id, NAME, "root", d.documents, d.chunks))


def texts_of(collection):
    out = {}
    for r in collection.chunks.orderBy("document_id", "start_offset").collect():
        out.setdefault(r.document_id, []).append(r.text)
    assert sorted(out) == sorted(r.id for r in collection.documents.collect())
    return {k: " ".join(v) for k, v in out.items()}


@pytest.fixture
def base(tmp_path):
    return str(tmp_path / "base")


def test_writers_that_overlap_keep_both(spark, base, monkeypatch):
    a, b = CollectionStore(spark, base), CollectionStore(spark, base)
    cid = begin(spark, a, {"x": "the start"}).id
    real, inner = CollectionStore._write, []

    def slow(self, *args):
        """The other writer begins and ends while the first one has yet to write."""
        if self is a and not inner:
            inner.append(b.append(cid, delta(spark, {"from-b": "by b", "x": "x by b"})))
            assert texts_of(b.load(cid)) == {"from-b": "by b", "x": "x by b"}
        real(self, *args)

    monkeypatch.setattr(CollectionStore, "_write", slow)
    found = texts_of(a.append(cid, delta(spark, {"from-a": "by a", "x": "x by a"})))
    assert found.pop("x") in ("x by a", "x by b") and found == {"from-a": "by a", "from-b": "by b"}
    assert texts_of(b.load(cid)) | {"x": ""} == found | {"x": ""}


def test_a_reader_never_sees_half_a_segment(spark, base, monkeypatch):
    store = CollectionStore(spark, base)
    cid = begin(spark, store, {"x": "the start"}).id
    seen = []
    real = inverted.clustered_postings
    monkeypatch.setattr("florilege.sources.store.clustered_postings", lambda rows: seen.append(texts_of(store.load(cid))) or real(rows))
    store.append(cid, delta(spark, {"y": "more"}, ["x"]))
    assert seen == [{"x": "the start"}] and texts_of(store.load(cid)) == {"y": "more"}
    monkeypatch.setattr("florilege.sources.store.term_statistics", lambda rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.append(cid, delta(spark, {"z": "never"}))
    assert texts_of(store.load(cid)) == {"y": "more"}


def test_compaction_beside_a_writer_and_another_compaction(spark, base, monkeypatch):
    a, b = CollectionStore(spark, base), CollectionStore(spark, base)
    cid = begin(spark, a, {"x": "the start"}).id
    a.append(cid, delta(spark, {"y": "one"}))
    real, inner = CollectionStore._write, []

    def slow(self, *args):
        if self is a and not inner:
            inner.append(1)
            b.append(cid, delta(spark, {"y": "two", "z": "late"}))
            b.compact(cid)  # its folders stay, since the other still reads them
        real(self, *args)

    monkeypatch.setattr(CollectionStore, "_write", slow)
    assert texts_of(a.compact(cid, keep_seconds=0)) == {"x": "the start", "y": "two", "z": "late"}
    a.append(cid, delta(spark, {"y": "three"}, ["x"]))
    assert texts_of(b.compact(cid, keep_seconds=0)) == {"y": "three", "z": "late"}
    assert len(b._in_force(cid)[0]) == 1
    assert texts_of(b.compact(cid, keep_seconds=0)) == {"y": "three", "z": "late"}
    left = os.listdir(f"{base}/{cid}/chunks")
    assert len(left) == 1, left


def test_folders_stay_while_a_plan_may_read_them(spark, base):
    store = CollectionStore(spark, base)
    cid = begin(spark, store, {"x": "the start"}).id
    old = store.append(cid, delta(spark, {"y": "one"}))
    store.compact(cid)
    assert texts_of(old) == {"x": "the start", "y": "one"}


def test_an_engine_sees_what_another_saved(spark, tmp_path):
    from florilege.api import Engine

    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.txt").write_text("first")
    one, two = (Engine(spark, str(tmp_path / "base")) for _ in range(2))
    one.index(str(root), "n")
    assert two.load("n").chunks.count() == 1
    (root / "b.txt").write_text("second")
    one.index(str(root), "n")
    assert two.load("n").chunks.count() == 2 and two.list_collections().first().doc_count == 2


WORDS = ["common"] * 30 + ["often"] * 12 + [f"w{k}" for k in range(40)]


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """A collection after random additions, updates and removals, and what its documents should be."""
    rng, store, state = random.Random(4), CollectionStore(spark, str(tmp_path_factory.mktemp("grown"))), {}
    text = lambda: " ".join(rng.choices(WORDS, k=rng.randrange(1, 60)))
    state = {f"d{k}": text() for k in range(80)}
    cid = begin(spark, store, state).id
    for _ in range(4):
        new = {f"d{rng.randrange(120)}": text() for _ in range(12)}
        lost = rng.sample(sorted(state.keys() - new.keys()), 5)
        found = store.append(cid, delta(spark, new, lost))
        state = {k: v for k, v in (state | new).items() if k not in lost}
    return store, found, state


QUESTIONS = ["common w1 w2", "often common", "w3", "common", "unheard of", "", "w5 w6 w7 w8 w9 w10 often", "W1 w1 COMMON w39"]


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, text string")


def test_statistics_equal_a_recount(spark, grown):
    _, found, state = grown
    assert sorted(r.id for r in found.documents.collect()) == sorted(state)
    fresh = delta(spark, state).chunks.persist()
    terms = spark.createDataFrame([(w,) for w in sorted(set(WORDS)) + ["unheard"]], "term string")
    assert {r.term: r.df for r in found.index.document_frequency(terms).collect()} == {r.term: r.df for r in document_frequency(fresh).collect()}
    stats = corpus_stats(fresh).first()
    assert found.index.corpus_stats() == (stats.n, stats.total_dl)


@pytest.mark.parametrize("literal", [256, 2])
@pytest.mark.parametrize("k", [1, 3, 10, 1000])
def test_pruned_search_gives_the_rows_of_the_plain_one(spark, grown, questions, monkeypatch, literal, k):
    _, found, state = grown
    monkeypatch.setattr(inverted, "LITERAL_TERMS", literal)
    monkeypatch.setattr(inverted, "SEED_POSTINGS", 1)
    monkeypatch.setattr(inverted, "BROADCAST_LOOKUPS", 500_000 if literal > 2 else 3)
    got = found.index.search(questions, k)
    want = KeywordIndex(delta(spark, state).chunks).search(questions, k)
    rows = lambda f: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in f.collect())
    assert rows(got) == rows(want)


def test_questions_in_parts_and_empty_ones(spark, grown, questions, monkeypatch):
    _, found, _ = grown
    rows = lambda f: sorted(map(tuple, f.select("query_id", "rank", "chunk_id").collect()))
    whole = rows(found.index.search(questions, 5))
    monkeypatch.setattr(inverted, "BROADCAST_TERMS", 6)
    assert rows(found.index.search(questions, 5)) == whole
    assert found.index.search(questions.limit(0), 5).count() == 0
    empty = CollectionStore(spark, found.index.stored_postings.inputFiles()[0].split("/postings/")[0].removeprefix("file://") + "-none")
    assert empty.save(Collection.new(spark, "e")).index.search(questions, 5).count() == 0


def test_fewer_than_half_of_the_postings_are_scored(spark, tmp_path):
    """Over texts with words as frequent as in a language; counts what :class:`StoredIndex` scores."""
    rng = random.Random(9)
    vocabulary = [f"t{k}" for k in range(3_000)]
    weights = [1 / (k + 1) for k in range(3_000)]
    texts = {f"d{k}": " ".join(rng.choices(vocabulary, weights, k=60)) for k in range(1_500)}
    docs = spark.createDataFrame([(i, f"{i}.txt", t) for i, t in texts.items()], "id string, path string, text string")
    new = Collection.new(spark, "z")
    documents = docs.select("id", "path", F.lit("h").alias("hash"), F.lit("m").alias("mime_type"), F.lit(None).cast("timestamp").alias("indexed_at"))
    index = CollectionStore(spark, str(tmp_path)).save(Collection(new.id, "z", "r", documents, chunk_documents(docs).select(*CHUNKS.names))).index
    asked = spark.createDataFrame([(k, " ".join(["t0", "t1", "t2", "t4", f"t{150 + 37 * k}", f"t{300 + 41 * k}"])) for k in range(20)], "query_id long, text string")
    counted = {}

    def count(what, rows):
        counted[what] = rows.count()
        return rows

    index.scored = count
    got = sorted((r.query_id, r["rank"], r.chunk_id) for r in index.search(asked, 5).collect())
    assert got == sorted((r.query_id, r["rank"], r.chunk_id) for r in KeywordIndex(index.chunks).search(asked, 5).collect())
    every = asked.select("query_id", F.explode(F.split("text", " ")).alias("term")).join(index.postings(asked.select(F.explode(F.split("text", " ")).alias("term"))), "term").count()
    assert sum(counted.values()) < every / 2, (counted, every)


def scan_rows(frame):
    """Rows that the scans of an executed plan have given."""
    plan = frame._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan.executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        metrics = node.metrics()
        if "Scan" in node.nodeName() and metrics.contains("numOutputRows"):
            total += metrics.apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_a_question_reads_the_folders_of_its_terms(spark, grown):
    _, found, _ = grown
    terms = spark.createDataFrame([("w1",)], "term string")
    frame = found.index._asked(found.index.stored_postings, terms)
    assert {r.term for r in frame.collect()} == {"w1"}
    own = found.index.stored_postings.where(F.col("bucket") == frame.first().bucket).count()
    read, whole = scan_rows(frame), found.index.stored_postings.count()
    assert 0 < read <= own < whole / 2, (read, own, whole)


def test_orders_of_segments(spark, base):
    """Whatever the order in which segments come, the last by name counts."""
    for order in itertools.permutations([1, 2]):
        store = CollectionStore(spark, f"{base}/{order}")
        cid = begin(spark, store, {"x": "zero"}).id
        for k in order:
            store.append(cid, delta(spark, {"x": f"text {k}"}), name=f"s{k + 1:010d}-fixed")
        assert texts_of(store.load(cid)) == {"x": "text 2"}
        store.append(cid, delta(spark, {"x": "text 2 again"}), name="s0000000003-fixed")
        assert texts_of(store.load(cid)) == {"x": "text 2 again"} and len(store._in_force(cid)[0]) == 3


def test_a_segment_that_touches_many_documents_does_not_rewrite_all(spark, base, monkeypatch):
    """Whole collections are written anew in proportion to what has been added, whatever the number of ids touched."""
    monkeypatch.setattr("florilege.sources.store.MOST_GONE", 2)
    store, state = CollectionStore(spark, base), {f"d{k}": f"common text {k}" for k in range(6)}
    cid = begin(spark, store, state).id
    found = store.append(cid, delta(spark, {"d0": "other words", "new": "common new"}, ["d1", "d2"]))
    state = {k: v for k, v in state.items() if k not in ("d1", "d2")} | {"d0": "other words", "new": "common new"}
    assert [r.stands_for is None for r in store._in_force(cid)[0]] == [False, True]  # beside the first, not instead of it
    assert texts_of(found) == state
    terms = spark.createDataFrame([("common",), ("other",)], "term string")
    assert {r.term: r.df for r in found.index.document_frequency(terms).collect()} == {"common": 4, "other": 1}
    assert found.index.postings(terms).count() == 5 and found.index.corpus_stats()[0] == 5
    found = store.append(cid, delta(spark, {f"d{k}": "third text" for k in range(3, 6)}))
    state |= {f"d{k}": "third text" for k in range(3, 6)}
    assert len(store._in_force(cid)[0]) == 1 and texts_of(found) == state  # seven ids are more than the first had


@pytest.mark.parametrize("run", [2_000_000, 7])
def test_postings_are_sorted_by_term_before_spark_sorts_by_bucket(spark, monkeypatch, run):
    monkeypatch.setattr(inverted, "SORTED_POSTINGS", run)
    monkeypatch.setattr(inverted, "_GIVEN", 5)
    rng = random.Random(8)
    texts = {f"d{k}": " ".join(rng.choices(WORDS, k=rng.randrange(30))) for k in range(40)}
    chunks = delta(spark, texts).chunks.select(*CHUNKS.names).coalesce(1)
    chunks = chunks.unionByName(chunks.where("id = ''").select(*CHUNKS.names))  # a task without chunks
    found = inverted.clustered_postings(chunks).collect()
    flat = chunks.select(F.explode("terms").alias("t"), "document_id", "id", "dl").select("t.term", "document_id", "id", "t.tf", "dl", inverted.bucket_of(F.col("t.term")))
    assert sorted(map(tuple, found)) == sorted(map(tuple, flat.collect()))
    assert [r.bucket for r in found] == sorted(r.bucket for r in found)
    if run > 1000:
        assert [(r.bucket, r.term) for r in found] == sorted((r.bucket, r.term) for r in found)
