"""Renderings of answers, reports and listings as string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import one_line, three_digits
from florilege.operators.ingest import STATUSES


def answer_json(answers: DataFrame) -> DataFrame:
    """``query_id, json`` with text, citations (null for a refusal), confidence and answerable, in this order."""
    return answers.select("query_id", F.to_json(F.struct("text", "citations", "confidence", "answerable"), {"ignoreNullFields": "false"}).alias("json"))


def _cited(answers: DataFrame) -> Column:
    return F.col("answerable") & (F.coalesce(F.size("citations"), F.lit(0)) > 0)


def answer_text(answers: DataFrame) -> DataFrame:
    """``query_id, rendered``: the text and, if there are citations, the sources with scores."""
    lines = F.array_join(F.transform("citations", lambda c: F.concat(F.lit("  - "), c["document_path"], F.lit(" (score "), three_digits(c["score"]), F.lit(")\n"))), "")
    return answers.select("query_id", F.concat("text", F.lit("\n"), F.when(_cited(answers), F.concat(F.lit("\nSources:\n"), lines)).otherwise("")).alias("rendered"))


def session_sections(answers: DataFrame, *keep: str) -> DataFrame:
    """``seq, section`` of ``answers(seq, question, text, citations, answerable)``, after the columns ``keep``: a Markdown section for each exchange."""
    source = lambda c: F.concat(F.lit("- `"), c["document_path"], F.lit("` (score "), three_digits(c["score"]), F.lit("): "), one_line(c["snippet"]), F.lit("\n"))
    sources = F.concat(F.lit("**Sources:**\n\n"), F.array_join(F.transform("citations", source), ""), F.lit("\n"))
    head = F.concat(F.lit("## Q"), F.col("seq").cast("string"), F.lit(": "), F.col("question"), F.lit("\n\n"), F.col("text"), F.lit("\n\n"))
    return answers.select(*keep, "seq", F.concat(head, F.when(_cited(answers), sources).otherwise("")).alias("section"))


def session_markdown(answers: DataFrame, collection: str, exported_at: str) -> str:
    """A session as one Markdown text; a session is what one person asked, so it is gathered in order."""
    sections = session_sections(answers).orderBy("seq").toLocalIterator()
    return f"# Session — {collection}\n\n_Exported {exported_at}_\n\n" + "".join(r.section for r in sections)


def ingest_report(report: DataFrame) -> DataFrame:
    """One row with the number of files by status."""
    return report.groupBy().agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES))


def collection_summary(documents: DataFrame, chunks: DataFrame, by: str) -> DataFrame:
    """``by, doc_count, chunk_count`` of documents and their chunks; a document without chunks counts."""
    per = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    return documents.join(per, "id", "left").groupBy(by).agg(F.count("*").alias("doc_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"))


def listing_line(name: Column, docs: Column, chunks: Column, root: Column) -> Column:
    return F.format_string("%-20s  %5d docs  %6d chunks  root=%s", name, docs, chunks, root)
