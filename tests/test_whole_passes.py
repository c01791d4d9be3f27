"""Searches that leave chunks where they are: no cache, no shuffle of chunks, and the rows of plain versions."""

import pytest
from pyspark.sql import functions as F

from florilege import queries
from florilege.operators import inverted, keyword
from florilege.operators.chunk import chunk_documents
from florilege.operators.chunk_ranges import chunk_by_ranges
from florilege.schema import CHUNKS, ChunkOptions
from florilege.sources.folders import among
from florilege.sources.store import Collection, CollectionStore
from jobs.index_documents import current_chunks, index_documents


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    texts = [(i, " ".join(f"w{(i * k) % 23}" for k in range(i % 40)), "s", "en") for i in range(120)]
    spark.createDataFrame(texts, "doc_id long, text string, source string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, f"w{i % 23} w{i % 7} w{i % 7} none") for i in range(40)] + [(99, "none")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_chunks_are_scored_where_they_are(spark, tables, monkeypatch):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), F.lit("p").alias("path"), "text")
    chunks = chunk_documents(docs, ChunkOptions(8, 2))
    asked = spark.read.parquet(f"{tables}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    scored = keyword.bm25_scores(chunks, asked)
    assert "Exchange" not in plan(scored)
    top = lambda: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in keyword.KeywordIndex(chunks).search(asked, 7).collect())
    every = lambda rows: {(r.query_id, r.chunk_id): round(r.score, 9) for r in rows.collect()}
    best, all_ = top(), every(scored)
    monkeypatch.setattr(keyword, "_SCORES", 90)  # slices of two chunks
    assert top() == best
    monkeypatch.setattr(keyword, "BEST_QUESTIONS", 3)
    assert top() == best
    monkeypatch.setattr(keyword, "BROADCAST_TERMS", 0)
    assert top() == best and every(keyword.bm25_scores(chunks, asked)) == all_


@pytest.mark.parametrize("name", ["term_idf", "bm25_topk", "rrf_fusion", "hybrid_topk", "answers"])
def test_no_query_holds_chunks_in_executors(spark, tables, name):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    queries.QUERIES[name](spark, tables).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_many_rows_stay_where_they_are(spark):
    found = among(spark.range(50_000).withColumn("x", F.repeat(F.lit("x"), 500)), spark.range(10).groupBy("id").count(), "id")
    assert found.count() == 10 and "SortMergeJoin" not in plan(found) and "hashpartitioning" not in plan(found)


def test_chunks_in_force_are_read_without_a_shuffle(spark, tables, tmp_path):
    index_documents(spark, f"{tables}/documents.parquet", f"{tmp_path}/index", f"{tmp_path}/checkpoint")
    found = current_chunks(spark, f"{tmp_path}/index")
    assert found.select("document_path").distinct().count() == 117 and "Exchange" not in plan(found)


def test_many_questions_move_a_posting_once(spark, tables, tmp_path, monkeypatch):
    """Questions with terms in common, from the stored index: what is scored are the terms' postings, not those of each question."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), F.lit("p").alias("path"), "text")
    asked = spark.read.parquet(f"{tables}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    new = Collection.new(spark, "c")
    documents = docs.select("id", "path", F.lit("h").alias("hash"), F.lit("m").alias("mime_type"), F.lit(None).cast("timestamp").alias("indexed_at"))
    index = CollectionStore(spark, str(tmp_path)).save(Collection(new.id, "c", "r", documents, chunk_documents(docs, ChunkOptions(8, 2)).select(*CHUNKS.names))).index
    seen = []
    index.scored = lambda what, rows: seen.append(what) or rows
    rows = lambda f: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in f.collect())
    want = rows(keyword.KeywordIndex(index.chunks).search(asked, 7))
    monkeypatch.setattr(inverted, "SHARED_POSTINGS", 100)
    assert rows(index.search(asked, 7)) == want and seen == ["seed", "shared"]
    assert "Exchange" not in plan(inverted.clustered_postings(index.chunks))


def test_ranges_are_counted_many_at_a_time(spark):
    """Pieces come in batches of many ranges, and a document whose windows all have text needs no numbering by a window."""
    docs = spark.createDataFrame([(f"d{k}", f"{k}.txt", "one two three four five six " * 9) for k in range(30)], "id string, path string, text string").coalesce(1)
    found = chunk_by_ranges(docs, ChunkOptions(7, 2), columns=("id", "text", "dl"), chars=20)
    assert "RowNumber" not in plan(found) and "row_number" not in plan(found) and "Join" not in plan(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, chunk_documents(docs, ChunkOptions(7, 2), columns=("id", "text", "dl")).collect()))


def test_chunks_without_a_term_of_any_question(spark):
    docs = spark.createDataFrame([(f"d{k}", "p", t) for k, t in enumerate(["red green", "blue", ""])], "id string, path string, text string").repartition(3)
    asked = spark.createDataFrame([(1, "blue"), (2, "none")], "query_id long, text string")
    assert [(r.query_id, r["rank"]) for r in keyword.KeywordIndex(chunk_documents(docs)).search(asked, 3).collect()] == [(1, 1)]


def test_an_ingestion_leaves_contents_and_kept_chunks_where_they_are(spark, tables, monkeypatch):
    """Neither the contents of unchanged files nor the chunks of documents that stay are shuffled; the rows are the same if they are."""
    chunks = lambda: queries.QUERIES["ingest_chunks"](spark, tables)
    found = chunks()
    assert "SortMergeJoin" not in plan(found) and "Exchange hashpartitioning" not in plan(found)
    assert "embedding" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(tuple, found.collect()))
    assert len(want) == spark.read.parquet(f"{tables}/documents.parquet").where("doc_id % 7 != 0 and doc_id % 11 != 1 and doc_id % 13 != 2 and length(text) > 0").count()
    for few, ids in ((0, 2_000_000), (0, 0)):
        monkeypatch.setattr("florilege.sources.files.BROADCAST_ROWS", few)
        monkeypatch.setattr("florilege.sources.files.BROADCAST_IDS", ids)
        monkeypatch.setattr("florilege.operators.ingest.BROADCAST_IDS", ids)
        assert sorted(map(tuple, chunks().collect())) == want
