"""The jobs as queries: each runs its job twice, over the whole tables, into one new folder, and returns all that stands there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.queries import HYBRID_SQL, chunk_sql
from florilege.sources.folders import fresh_path
from jobs.answer_questions import answer_questions, read_answers, read_citations
from jobs.index_documents import current_chunks, index_documents


def _indexed(spark: SparkSession, d: str, folder: str) -> str:
    index_documents(spark, f"{d}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    return f"{folder}/index"


def job1_index_documents(spark: SparkSession, d: str) -> DataFrame:
    """The index after two runs, of which the second finds nothing new."""
    folder = fresh_path(spark, "job1")
    for _ in range(2):
        index = _indexed(spark, d, folder)
    terms = F.size("terms").cast("long")
    return current_chunks(spark, index).select("lang", "document_path", F.col("id").alias("chunk_id"), "start_offset", "end_offset", F.col("dl").cast("long").alias("dl"), terms.alias("n_terms"), F.sha2("text", 256).alias("text_sha256"))


def job2_answer_questions(spark: SparkSession, d: str) -> DataFrame:
    """All citations, with their questions' answers, after two runs."""
    folder = fresh_path(spark, "job2")
    index = _indexed(spark, d, folder)
    for _ in range(2):
        answer_questions(spark, index, f"{d}/benchmark.parquet", f"{folder}/answers", {"threshold": 0.5})
    answers = read_answers(spark, f"{folder}/answers").select("run", "query_id", "answerable", F.round("confidence", 6).alias("confidence"), "n_citations")
    cited = read_citations(spark, f"{folder}/answers").select("run", "query_id", "lang", "rank", "chunk_id", "document_path", F.round("score", 9).alias("score"))
    return answers.join(cited, ["run", "query_id"], "left").drop("run")


QUERIES = {"job1_index_documents": job1_index_documents, "job2_answer_questions": job2_answer_questions}
ORACLE_SQL = {
    "job1_index_documents": f"""with {chunk_sql()}, tk as (select *, regexp_extract_all(lower(text), '[A-Za-z0-9_]+') as t from chunk)
select lang, document_path, chunk_id, start_offset::bigint as start_offset, end_offset::bigint as end_offset, len(t)::bigint as dl, len(list_distinct(t))::bigint as n_terms, sha256(tk.text) as text_sha256
from tk join documents d on document_path = 'documents/' || d.doc_id || '.txt'""",
    "job2_answer_questions": f"""{HYBRID_SQL}, conf as (select query_id, max(score) as confidence from cs group by query_id),
cited as (select query_id, lang, rank::integer as rank, chunk_id, document_path, round(ftop.score, 9) as score from ftop join chunk using (chunk_id) join documents d on document_path = 'documents/' || d.doc_id || '.txt' join conf using (query_id) where confidence >= 0.5)
select query_id, confidence >= 0.5 as answerable, round(confidence, 6) as confidence, (select count(*) from cited c where c.query_id = conf.query_id)::integer as n_citations, lang, rank, chunk_id, document_path, score from conf left join cited using (query_id)""",
}
