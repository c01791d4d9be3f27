"""Chunks of very long documents: a text is cut into ranges that are worked on apart, and gives the chunks of the whole text.

A range counts the words that begin in it; running sums over a document's ranges number its words and bytes. Each range then gives
the pieces that windows have in it, a window being known by the numbers of its words, and pieces are put together by window. No
task sees more of a text than a range and one window, but for the row that the text comes in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florilege.functions.kernels import WHITE_SPACE, lists
from florilege.functions.text import chunk_id, page_number
from florilege.operators.chunk import DIM, bounded, chunk_documents, indexed
from florilege.schema import CHUNKS, ChunkOptions
from florilege.sources.folders import BROADCAST_ROWS, written

#: Characters of a range; bytes of a text beyond which it is cut into ranges.
RANGE_CHARS, LONG_BYTES = 4 << 20, 64 << 20
_WORD = re.compile(rb"[^ \n\t\r]+")
_ROWS = 256


def ranges(docs: DataFrame, chars: int) -> DataFrame:
    """``id, k, part, joined, path`` of ``docs(id, path, text)``: ranges by number, and whether the character before one belongs to a word."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / F.lit(chars)))
    rows = docs.where("text is not null").select("id", "path", "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    before = F.substring("text", F.col("k") * chars, F.lit(1))
    joined = (F.col("k") > 0) & ~before.isin(" ", "\n", "\t", "\r")
    return rows.select("id", "k", F.substring("text", F.col("k") * chars + 1, F.lit(chars)).alias("part"), joined.alias("joined"), "path")


def _starts(raw: bytes, joined: bool) -> list[int]:
    """Where words begin in a range; what goes on with a word of the range before begins none."""
    found = [m.start() for m in _WORD.finditer(raw)]
    return found[1:] if joined and found and found[0] == 0 else found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [t.encode() for t in batch.column(2).to_pylist()]
        words = [len(_starts(r, j)) for r, j in zip(raw, batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words, pa.int64()), pa.array(map(len, raw), pa.int64())], ["id", "k", "words", "bytes"])


def _pieces(size: int, step: int):
    """Rows ``id, window, k, start, piece, path`` of the pieces that windows have in ranges; start and path are null but in a window's first range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for doc, k, part, joined, words, first, at, total, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = part.encode()
                starts = _starts(raw, joined)
                last = 0 if total <= size else -(-(total - size) // step)
                for w in range(max(0, -(-(first - size) // step)), min(last, (first + words - 1) // step) + 1):
                    a, b = w * step, min(w * step + size, total)
                    if b < first or a >= first + words:
                        continue
                    low = starts[a - first] if a >= first else 0
                    high = starts[b - first] if b < first + words else len(raw)
                    if low < high:
                        rows.append((doc, w, k, at + low if a >= first else None, raw[low:high].decode(), path if a >= first else None))
                    if len(rows) == _ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "window", "k", "start", "piece", "path"])

    return run


def with_index_data(chunks: DataFrame, dim: int, made: Sequence[str]) -> DataFrame:
    """Chunks with the columns ``made`` of vectors, lengths and term counts of their texts."""
    at = chunks.columns.index("text")
    schema = T.StructType([*chunks.schema.fields, *(CHUNKS[c] for c in made)])
    make = {"embedding": lambda x: lists(x.vectors(dim)), "dl": lambda x: pa.array(x.n.astype(np.int32)), "terms": lambda x: x.terms()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, at):
                found = indexed(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, *(make[c](found) for c in made)], schema.names)

    return chunks.mapInArrow(run, schema)


def chunk_by_ranges(docs: DataFrame, options: ChunkOptions = ChunkOptions(), dim: int = DIM, columns: Sequence[str] = tuple(CHUNKS.names), chars: int = RANGE_CHARS) -> DataFrame:
    """The rows of :func:`florilege.operators.chunk.chunk_documents`, worked on by ranges of so many characters.

    Ids of ``docs(id, path, text[, boundaries])`` must differ, as those of a collection do. Ranges are written once; of a
    window's pieces, as of the running sums, a task holds one document's numbers, or one window.
    """
    size, step = options.normalised()
    parts = written(ranges(docs, chars), "ranges")
    kind = parts.schema["id"].dataType.simpleString()
    counted = parts.mapInArrow(_counts, f"id {kind}, k long, words long, bytes long")
    own, before = Window.partitionBy("id"), Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.select("id", "k", "words", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("at"), F.sum("words").over(own).alias("total"))
    pieces = parts.join(sums, ["id", "k"]).select("id", "k", "part", "joined", "words", "first", "at", "total", "path").mapInArrow(_pieces(size, step), "id string, window long, k long, start long, piece string, path string")
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda p: p["piece"]))
    whole = pieces.groupBy("id", "window").agg(F.max("start").alias("start_offset"), F.rtrim(joined, F.lit(" \n\t\r")).alias("raw"), F.max("path").alias("document_path"))
    whole = whole.withColumn("end_offset", F.col("start_offset") + F.octet_length("raw")).withColumn("text", F.trim("raw", F.lit(WHITE_SPACE))).drop("raw")
    whole = written(whole, "windows")
    # a window without text takes no number; of documents that have such ones, numbers alone are gathered
    gaps = written(whole.where("text = ''").select("id").distinct(), "gaps")
    few = gaps.count()
    full = whole.where("text != ''")
    if few:
        gaps = F.broadcast(gaps) if few <= BROADCAST_ROWS else gaps
        index = F.row_number().over(Window.partitionBy("id").orderBy("window")) - 1
        numbered = full.select("id", "window").join(gaps, "id", "left_semi").select("id", "window", index.alias("n"))
        own = full.join(gaps, "id", "left_semi").join(numbered, ["id", "window"])
        full = full.join(gaps, "id", "left_anti").withColumn("n", F.col("window")).unionByName(own.select(*full.columns, F.col("n").cast("long")))
    else:
        full = full.withColumn("n", F.col("window"))
    rows = full.withColumnRenamed("id", "document_id")
    if "boundaries" in docs.columns and "page_number" in columns:
        rows = rows.join(docs.select(F.col("id").alias("document_id"), F.col("boundaries").cast("array<long>").alias("boundaries")), "document_id")
    else:
        rows = rows.withColumn("boundaries", F.lit(None).cast("array<long>"))
    rows = rows.select(chunk_id(F.col("document_id"), F.col("n")).alias("id"), "document_id", "document_path", "text", "start_offset", "end_offset", page_number(F.col("boundaries"), F.col("start_offset")).alias("page_number"))
    made = [c for c in ("embedding", "dl", "terms") if c in columns]
    return (with_index_data(rows, dim if dim > 0 else DIM, made) if made else rows).select(*columns)


def chunk_all(docs: DataFrame, options: ChunkOptions = ChunkOptions(), dim: int = DIM, columns: Sequence[str] = tuple(CHUNKS.names), long_bytes: int = LONG_BYTES) -> DataFrame:
    """Chunks of documents of any length: one narrow pass for all but the very long ones, whose rows are the same by ranges.

    ``docs`` is asked for long texts first, and read twice if there are some: pass a written table.
    """
    is_long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))
    if not docs.where(is_long).limit(1).count():
        return chunk_documents(docs, options, dim, columns)
    return chunk_documents(docs.where(~is_long), options, dim, columns).unionByName(chunk_by_ranges(docs.where(is_long), options, dim, columns))
