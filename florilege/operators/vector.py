"""Exact cosine top-k: chunk vectors stream past bounded blocks of question vectors.

Up to a block of questions goes to every task, and chunks stay where they are. More questions are dealt into blocks, and so are
chunks; each pair of blocks is a task of bounded size, so that no question vector passes through the driver and the plan is the
same for any number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.operators.best import Best
from florilege.operators.chunk import DIM, embed_texts
from florilege.operators.keyword import ranked
from florilege.sources.folders import written

#: Questions of a block, chunks of a block, and chunks whose scores are held at a time.
QUESTION_BLOCK, CHUNK_BLOCK, _SLICE = 4096, 16_384, 512
_HITS = "query_id long, chunk_id string, score double"


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the asked length as doubles, and which rows those are."""
    size = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dim)
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64), rows


def cosine_top_k(chunks: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk_id, score, rank`` of the k nearest rows of ``chunks(id, embedding)`` to each of ``vectors(query_id, embedding)``.

    Zero, empty or unequally long vectors have cosine 0 and take part. A task keeps k rows per question before anything is
    shuffled.
    """
    vectors = vectors.select("query_id", "embedding")
    few = vectors.limit(QUESTION_BLOCK + 1).collect()
    if len(few) <= QUESTION_BLOCK:
        block = Block([r.query_id for r in few], [r.embedding for r in few], k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block.clear()
            for batch in batches:
                block.meet(batch.column(0), batch.column(1))
            yield block.found()

        return ranked(chunks.select("id", "embedding").mapInArrow(run, _HITS), k)
    vectors = written(vectors, "questions")  # so many are embedded once, not for each of the passes below
    blocks = lambda rows, size: max(1, -(-rows.count() // size))
    questions, parts = blocks(vectors, QUESTION_BLOCK), blocks(chunks.select("id"), CHUNK_BLOCK)
    own_q, own_c = (F.pmod(F.xxhash64(key), F.lit(n)).cast("int") for key, n in (("query_id", questions), ("id", parts)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    none_id, none_name = F.lit(None).cast("long"), F.lit(None).cast("string")
    tiles = vectors.select(own_q.alias("q"), every(parts).alias("c"), F.col("query_id").cast("long").alias("query_id"), none_name.alias("id"), "embedding")
    tiles = tiles.unionByName(chunks.select(every(questions).alias("q"), own_c.alias("c"), none_id.alias("query_id"), "id", "embedding"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asked = table.filter(pc.is_valid(table["query_id"]))
        met = table.filter(pc.is_null(table["query_id"])).combine_chunks()
        block = Block(asked["query_id"].to_pylist(), asked["embedding"].to_pylist(), k)
        for batch in met.to_batches():
            block.meet(batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("embedding")))
        return pa.Table.from_batches([block.found()])

    return ranked(tiles.groupBy("q", "c").applyInArrow(compare, _HITS), k)


class Block:
    """Question vectors, and the k nearest chunks to each of those that it has met."""

    def __init__(self, ids: list[int], vectors: list, k: int):
        self.ids, self.k = np.array(ids, np.int64), k
        dims = np.array([len(v or ()) for v in vectors], np.int64)
        groups = [(int(d), np.flatnonzero(dims == d)) for d in np.unique(dims)]
        self.sides = [(d, own, np.array([vectors[i] for i in own], np.float64).reshape(len(own), d)) for d, own in groups if d]
        self.clear()

    def clear(self) -> None:
        self.best = Best(len(self.ids), self.k)

    def meet(self, names: pa.Array, embeddings: pa.Array) -> None:
        for low in range(0, len(names) if len(self.ids) else 0, _SLICE):
            some, n = embeddings.slice(low, _SLICE), len(names[low : low + _SLICE])
            score = np.zeros((len(self.ids), n))
            for d, own, q in self.sides:
                x, rows = _matrix(some, d)
                if len(rows):
                    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
                    with np.errstate(all="ignore"):
                        score[np.ix_(own, rows)] = np.where(norms > 0, q @ x.T / norms, 0.0)
            self.best.meet(names.slice(low, _SLICE), score)

    def found(self) -> pa.RecordBatch:
        q, names, score = self.best.found()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), names, pa.array(score)], ["query_id", "chunk_id", "score"])


def confidence(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``query_id, confidence``: the best cosine, 0 if there are no chunks."""
    top = cosine_top_k(chunks, vectors, 1).select("query_id", "score")
    return vectors.select("query_id").join(top, "query_id", "left").select("query_id", F.coalesce("score", F.lit(0.0)).alias("confidence"))


class VectorIndex:
    """A retriever over chunks; adding and removing give new indices."""

    def __init__(self, chunks: DataFrame, dim: int = DIM):
        self.chunks, self.dim = chunks, dim

    def add(self, chunks: DataFrame) -> VectorIndex:
        return VectorIndex(self.remove(chunks.select("id")).chunks.unionByName(chunks), self.dim)

    def remove(self, ids: DataFrame) -> VectorIndex:
        return VectorIndex(self.chunks.join(ids.select("id"), "id", "left_anti").select(*self.chunks.columns), self.dim)

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        return cosine_top_k(self.chunks, embed_texts(questions, "query_id", self.dim), k)
