"""Score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF = 60.0


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for empty, zero or unequally long vectors. Not clamped."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25(idf_: Column, tf: Column, dl: Column, avg_dl: Column) -> Column:
    return idf_ * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / avg_dl))


def log_tf(count: Column) -> Column:
    return F.when(count > 0, F.lit(1.0) + F.log(count)).otherwise(F.lit(0.0))


def rrf(rank: Column) -> Column:
    return F.lit(1.0) / (F.lit(RRF) + rank)


def fetch_size(top_k: int) -> int:
    """Candidates of each retriever."""
    return max(20, 4 * top_k)
