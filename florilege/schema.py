"""Schemas of the engine's tables, and the options of its operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()


def _table(**columns: T.DataType) -> T.StructType:
    """Spelled out, since modules are loaded on executors too, where no DDL can be parsed."""
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


#: ``modified`` (microseconds) and ``length`` are those of the file when it was read; null if they were not known.
DOCUMENTS = _table(id=_STRING, path=_STRING, hash=_STRING, mime_type=_STRING, indexed_at=T.TimestampType(), modified=_LONG, length=_LONG)
#: A chunk with its derived index data: its vector, its length in tokens and its term frequencies.
CHUNKS = _table(
    id=_STRING, document_id=_STRING, document_path=_STRING, text=_STRING, start_offset=_LONG, end_offset=_LONG, page_number=_INT,
    embedding=T.ArrayType(T.FloatType()), dl=_INT, terms=T.ArrayType(_table(term=_STRING, tf=_INT)),
)
COLLECTION = _table(id=_STRING, name=_STRING, root_path=_STRING)
QUESTIONS = _table(query_id=_LONG, text=_STRING, top_k=_INT)
CITATION = _table(chunk_id=_STRING, document_path=_STRING, snippet=_STRING, score=T.DoubleType())
ANSWERS = _table(query_id=_LONG, text=_STRING, citations=T.ArrayType(CITATION), confidence=T.DoubleType(), answerable=T.BooleanType(), error=_STRING)


def shaped(rows: DataFrame, kind: T.StructType) -> DataFrame:
    """The columns of a table in its order; those that ``rows`` lacks are null."""
    there = set(rows.columns)
    return rows.select(*(F.col(f.name) if f.name in there else F.lit(None).cast(f.dataType).alias(f.name) for f in kind))


@dataclass(frozen=True)
class ChunkOptions:
    """Window size and overlap in words. A size of 0 or less means the defaults; an overlap of the size or more, a quarter of it."""

    size: int = 220
    overlap: int = 40

    def normalised(self) -> tuple[int, int]:
        """Size and step; the step is at least 1, and over the size if the overlap is negative."""
        size, overlap = (self.size, self.overlap) if self.size > 0 else (220, 40)
        return size, size - (size // 4 if overlap >= size else overlap)


@dataclass(frozen=True)
class AnswerOptions:
    """How many chunks to retrieve, and the least cosine at which a question counts as answerable."""

    top_k: int = 5
    threshold: float = 0.15


def checked_top_k(top_k: int) -> int:
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    return top_k or AnswerOptions.top_k
