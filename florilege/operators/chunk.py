"""Chunking, embedding and term counts in one narrow pass over parsed documents.

A chunk carries its vector and its term frequencies, so neither building the vector index nor the inverted index needs a
shuffle: the ``postings`` are an explode, and only the terms that a question asks for are ever moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florilege.functions.kernels import WHITE_SPACE, Indexed, cut, joined, lists
from florilege.schema import CHUNKS, ChunkOptions

DIM = 256
#: Chunks of an Arrow batch, and bytes of documents that are cut at a time.
_ROWS, _BYTES = 512, 1 << 20


def chunk_documents(docs: DataFrame, options: ChunkOptions = ChunkOptions(), dim: int = DIM, columns: Sequence[str] = tuple(CHUNKS.names), keep: Sequence[str] = ()) -> DataFrame:
    """Chunks of ``docs(id, path, text[, boundaries])``, embedded and counted: rows of ``CHUNKS``, or of some of its columns.

    Offsets are bytes of the text's UTF-8 form. Windows without text take no index. Documents without words, and null texts,
    have no chunks. ``boundaries`` (byte offsets where pages 2.. begin) gives page numbers; without it, or empty, they are null.
    Nothing can be pruned from a pass through Python, so ``columns`` says what is to be made: vectors and terms cost most.
    ``keep`` names further columns of ``docs`` that each chunk takes from its document; they come last.
    """
    size, step = options.normalised()
    dim = dim if dim > 0 else DIM
    bounds = F.col("boundaries").cast("array<long>") if "boundaries" in docs.columns else F.lit(None).cast("array<long>")
    kept = [docs.schema[c] for c in keep]
    schema, wanted = T.StructType([*(CHUNKS[c] for c in columns), *kept]), set(columns)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Chunks of some documents."""
        texts = batch.column(2).cast(pa.binary()).fill_null(b"").to_pylist()
        raw, begin, _ = joined(texts)
        own, start, end = cut(raw, begin, size, step)
        parts = [raw[a:b].decode("utf-8", "replace").strip(WHITE_SPACE) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        full = np.flatnonzero([bool(p) for p in parts])
        own, start, end, parts = own[full], start[full], end[full], [parts[i] for i in full.tolist()]
        index = np.arange(len(own)) - np.searchsorted(own, own)
        ids = batch.column(0).to_pylist()
        pages = [sorted(p or []) for p in batch.column(3).to_pylist()] if "page_number" in wanted else []
        for low in range(0, len(own), _ROWS):
            some = slice(low, low + _ROWS)
            doc, at = own[some], start[some] - begin[own[some]]
            found = Indexed(raw, start[some], end[some]) if wanted & {"embedding", "dl", "terms"} else None
            make = {
                "id": lambda: pa.array([hashlib.sha1(f"{ids[d]}:{i}".encode()).hexdigest()[:16] for d, i in zip(doc.tolist(), index[some].tolist(), strict=True)], pa.string()),
                "document_id": lambda: batch.column(0).take(pa.array(doc)),
                "document_path": lambda: batch.column(1).take(pa.array(doc)),
                "text": lambda: pa.array(parts[some], pa.string()),
                "start_offset": lambda: pa.array(at),
                "end_offset": lambda: pa.array(end[some] - begin[doc]),
                "page_number": lambda: pa.array([1 + int(np.searchsorted(pages[d], a, "right")) if pages[d] else None for d, a in zip(doc.tolist(), at.tolist(), strict=True)], pa.int32()),
                "embedding": lambda: lists(found.vectors(dim)),
                "dl": lambda: pa.array(found.n.astype(np.int32)),
                "terms": lambda: found.terms(),
            }
            kept_values = [batch.column(4 + i).take(pa.array(doc)) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*(make[c]() for c in columns), *kept_values], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 2):
                yield from rows(part)

    return docs.select("id", "path", "text", bounds.alias("boundaries"), *keep).mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``_ROWS`` rows and, but for single rows, ``_BYTES`` of the text column."""
    size = np.cumsum(np.asarray(pc.binary_length(batch.column(text)).fill_null(0), np.int64))
    low = 0
    while low < batch.num_rows:
        before = size[low - 1] if low else 0
        high = min(low + _ROWS, max(low + 1, int(np.searchsorted(size, before + _BYTES, "right"))))
        yield batch.slice(low, high - low)
        low = high


def indexed(texts: pa.Array) -> Indexed:
    """The tokens of whole texts; a null has none."""
    return Indexed(*joined(texts.cast(pa.binary()).fill_null(b"").to_pylist()))


def bucket_counts(texts: DataFrame, key: str, dim: int = DIM) -> DataFrame:
    """``key, counts``: how many features of each of ``texts(key, text)`` fall into each bucket, from 0; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), lists(indexed(part.column(1)).counts(dim))], [key, "counts"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, counts array<long>")


def embed_texts(texts: DataFrame, key: str, dim: int = DIM) -> DataFrame:
    """``key, embedding`` of every row of ``texts(key, text)``; a text without tokens has the zero vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), lists(indexed(part.column(1)).vectors(dim))], [key, "embedding"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, embedding array<float>")


def reembed(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """Chunks with vectors of another dimension, without chunking anew."""
    vectors = embed_texts(chunks.select("id", "text"), "id", dim)
    return chunks.drop("embedding").join(vectors, "id").select(*CHUNKS.names)
