"""A hashed bitmap of ids, of bounded size, that spares most rows of a large table the shuffle of a join with those ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each id, and the least and most words of 64 bits: the bitmap's table has at most 2^20 rows of 16 bytes. Beyond eight
#: million ids, with all words in use, more and more rows match without being asked for; that costs time, never a row.
BITS, LEAST_WORDS, MOST_WORDS = 8, 1 << 10, 1 << 20


def _place(column: str, words: int) -> str:
    return f"pmod(xxhash64(cast(`{column}` as bigint)), {words * 64})"


def split_by_ids(rows: DataFrame, key: str, ids: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among the ids, and rows whose key surely is not (those with a null key too).

    Both together are all of ``rows``. The ids are counted and read: pass a written table.
    """
    n = ids.count()
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << (n * BITS // 64).bit_length()))
    own, asked = _place(id_column, words), _place(key, words)
    bitmap = ids.where(F.col(id_column).isNotNull()).selectExpr(f"cast({own} >> 6 as int) as bm_word", f"shiftleft(1L, cast({own} & 63 as int)) as bm_bit")
    bitmap = bitmap.groupBy("bm_word").agg(F.bit_or("bm_bit").alias("bm_bits"))
    joined = rows.join(F.broadcast(bitmap), F.expr(f"cast({asked} >> 6 as int) = bm_word"), "left")  # at most MOST_WORDS rows
    hit = F.expr(f"coalesce(getbit(bm_bits, cast({asked} & 63 as int)) = 1, false)")
    return joined.where(hit).select(*rows.columns), joined.where(~hit).select(*rows.columns)
