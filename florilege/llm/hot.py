"""Joins by keys of which a few may be as frequent as a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key beyond which it is hot, and hot keys that are broadcast at most: were there more, the first number is doubled.
HOT_ROWS, MOST_HOT = 20_000, 500_000


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` inner-joined with ``table``, which has one row for each key and says in ``n`` how many of ``rows`` have it.

    Rows of hot keys stay where they are and meet their keys' rows by a broadcast, whose size the counts bound; all others are
    shuffled, so no task gets more rows of one key than ``HOT_ROWS``. ``n`` is left out. Pass a written table: it is counted.
    """
    limit = HOT_ROWS
    while (found := table.where(F.col(n) > limit).limit(MOST_HOT + 1).count()) > MOST_HOT:
        limit *= 2
    if not found:
        return rows.join(table.drop(n), keys)
    hot = table.where(F.col(n) > limit)
    met = rows.join(F.broadcast(hot.drop(n)), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(n) <= limit).drop(n), keys)
    return met.unionByName(others)
