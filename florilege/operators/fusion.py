"""Hybrid search: reciprocal-rank fusion of the vector and the keyword ranking."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.functions import scores
from florilege.operators.chunk import DIM
from florilege.operators.keyword import KeywordIndex, ranked
from florilege.operators.vector import VectorIndex
from florilege.schema import checked_top_k


class Retriever(Protocol):
    """Finds ``query_id, chunk_id, score, rank`` of the k best chunks of each question."""

    def search(self, questions: DataFrame, k: int) -> DataFrame: ...


def fuse(rankings: list[DataFrame], top_k: int) -> DataFrame:
    """``query_id, chunk_id, score, rank`` from rankings with ``query_id, chunk_id, rank``: a union and a sum, no join."""
    parts = [r.select("query_id", "chunk_id", scores.rrf(F.col("rank")).alias("part")) for r in rankings]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return ranked(both.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score")), top_k)


def hybrid_search(chunks: DataFrame, questions: DataFrame, top_k: int = 0, dim: int = DIM, keyword: Retriever | None = None) -> DataFrame:
    """The ``top_k`` chunks of each of ``questions(query_id, text)`` by fused rank; every chunk is a vector candidate, so there
    are results without a lexical match too. ``keyword`` is a stored index of the same chunks; without it their terms are read."""
    top_k = checked_top_k(top_k)
    k = scores.fetch_size(top_k)
    return fuse([VectorIndex(chunks, dim).search(questions, k), (keyword or KeywordIndex(chunks)).search(questions, k)], top_k)
