"""The corpus pipeline: rules, classifier, near-duplicates, redaction and packing, each stage written before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from florilege.llm import jaccard, packing, pii, quality, rules
from florilege.llm.queries import VOCABULARY
from florilege.llm.storage import discard, materialize, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep."""
    return rules.filter_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of quality 1; learned from all labelled documents of the corpus."""
    corpus, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return quality.filter_documents(docs, corpus, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near-duplicates."""
    return jaccard.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data redacted."""
    return pii.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; all but the last are written as Parquet to the shared folder.

    Null and empty texts and documents of few words go in the first stage. Rows that repeat a doc_id with equal texts all stay
    or go together; rows with a null doc_id are no copies of any. An empty table gives no rows. What a stage writes for itself
    is deleted at its end, and its result once the next one is written; the pieces that the last result reads stay.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, keep=True)
        if before is not None:
            discard(spark, before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(spark, docs)  # the pieces have been written
    return out
