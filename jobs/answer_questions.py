"""Answers to a table of questions from an index: cited passages, refusals, and how much each language of the corpus is cited.

    spark-submit jobs/answer_questions.py --index <folder> --questions <table> --target <folder> [--config jobs/answer_questions.json]

The index is what ``jobs/index_documents.py`` has written; questions are Parquet with ``item_id`` and ``text``. Each question is
answered by hybrid search, or refused where the best cosine is below the threshold.

    target/answers/run=<run>/answerable=<true|false>/   question, answer, confidence, number of citations
    target/citations/run=<run>/lang=<lang>/             rank, chunk, path, snippet and score of each citation
    target/coverage/run=<run>/                          documents, cited documents and citations by language

A run's folders are replaced if it is run again, and give the same rows; those of other runs stay.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.plans.answer import answer
from florilege.schema import AnswerOptions
from florilege.sources.folders import among
from jobs import config
from jobs.index_documents import current_chunks

log = logging.getLogger("jobs.answer_questions")
DEFAULTS = {"top_k": 5, "threshold": 0.15, "run": "latest"}


def answer_questions(spark: SparkSession, index: str, questions: str, target: str, settings: dict | None = None) -> None:
    """Write answers, citations and coverage of one run."""
    settings = {**DEFAULTS, **(settings or {})}
    run = settings["run"]
    if not run or set(run) & set("/\\=*?[]{}"):
        raise ValueError(f"{run!r} can't name a folder")
    table = spark.read.parquet(questions)
    asked = table.where("item_id is not null").select(F.col("item_id").cast("long").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))
    # rows of one question count once; the text that sorts first is asked
    asked = asked.groupBy("query_id").agg(F.min("text").alias("text"))
    chunks = current_chunks(spark, index)
    answered = answer(chunks, asked, AnswerOptions(settings["top_k"], settings["threshold"]))
    path = lambda name: f"{target}/{name}/run={run}"
    cited = F.coalesce(F.size("citations"), F.lit(0))
    # citations are written with the answers, so that what follows reads them instead of asking again
    whole = answered.select("query_id", "question", "text", "confidence", cited.alias("n_citations"), "citations", "answerable")
    whole.write.mode("overwrite").partitionBy("answerable").parquet(path("answers"))
    written = spark.read.schema(whole.schema).parquet(path("answers"))
    lines = written.select("query_id", "confidence", F.posexplode("citations").alias("at", "c")).select("query_id", "confidence", (F.col("at") + 1).alias("rank"), "c.chunk_id", "c.document_path", "c.snippet", "c.score")
    langs = chunks.select(F.col("id").alias("chunk_id"), "lang")
    # citations are top_k a question, chunks are all of the corpus: only ids and languages of the latter are moved
    lines = among(langs, lines, "chunk_id").select(*lines.columns, "lang")
    lines.write.mode("overwrite").partitionBy("lang").parquet(path("citations"))
    rows = spark.read.schema(lines.schema).parquet(path("citations"))
    documents = chunks.groupBy("lang").agg(F.count_distinct("document_id").alias("documents"))
    cited_by = rows.groupBy("lang").agg(F.count_distinct("document_path").alias("cited_documents"), F.count("*").alias("citations"), F.count_distinct("query_id").alias("questions"))
    coverage = documents.join(cited_by, "lang", "left").fillna(0)
    coverage.write.mode("overwrite").parquet(path("coverage"))
    log.info("read %d questions and %d chunks; wrote %d answers, %d of them refused, and %d citations to %s", asked.count(), chunks.count(), written.count(), written.where("not answerable").count(), rows.count(), target)


def read_answers(spark: SparkSession, target: str) -> DataFrame:
    """Answers of all runs."""
    kind = "query_id long, question string, text string, confidence double, n_citations int, run string, answerable boolean"
    return spark.read.schema(kind).parquet(f"{target}/answers")


def read_citations(spark: SparkSession, target: str) -> DataFrame:
    """Citations of all runs."""
    kind = "query_id long, confidence double, rank int, chunk_id string, document_path string, snippet string, score double, run string, lang string"
    return spark.read.schema(kind).parquet(f"{target}/citations")


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Answer a table of questions from an index.")
    for name, what in (("index", "folder that jobs/index_documents.py has written"), ("questions", "Parquet table with item_id and text"), ("target", "folder of the answers")):
        parser.add_argument(f"--{name}", required=True, help=what)
    parser.add_argument("--config", help="JSON file; see jobs/answer_questions.json")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("answer-questions").getOrCreate()
    try:
        answer_questions(spark, args.index, args.questions, args.target, config.load(spark, args.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
