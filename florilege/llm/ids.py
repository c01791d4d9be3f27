"""Ids of documents as the operators take them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_long_id(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with ``key`` as a long: any integer type is widened; a TypeError names a column of another type."""
    kind = rows.schema[key].dataType
    if isinstance(kind, T.LongType):
        return rows
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        raise TypeError(f"{key} must be of an integer type, not {kind.simpleString()}")
    return rows.withColumn(key, F.col(key).cast("long"))
