"""Ranked lexical search as a blocked sparse matrix product in 64-bit integers.

Rows of the left matrix are items, with how often each term occurs in them; rows of the right one are terms, with their impact in
each document; a score is an entry of the product. Items are dealt into blocks of bounded size, whose terms make a dictionary.

1. :func:`term_matrix` finds the dictionary's terms in every whole text and writes one row per document: its terms' numbers and
   counts, and how many terms it has in all. From these rows come the number of documents, their total length, and how many
   documents hold each term.
2. :func:`rank_block` turns blocks of those rows by term, and for each item merges the rows of its terms into one row of scores
   (Gustavson's way, with a dense accumulator as wide as the block). A task keeps the k best documents of each item over all its
   blocks; these are cut to k by item, first within parts of the tasks, then in all.

Nothing is approximate: equal hashes of terms are compared byte by byte, and no document is left out before its score is known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.llm.ids import with_long_id
from florilege.llm.storage import materialize
from florilege.llm.textkernels import segment_hashes, sliced, utf8

#: Bytes of a block of items with their terms, about: what one pass over the documents holds in each task. Documents, and terms
#: of documents, of a block of the product. Parts of the first cut.
ITEM_BYTES, BLOCK_DOCS, BLOCK_TERMS, PARTS = 48 << 20, 8192, 1 << 21, 64
#: Fixed values of the weighting.
SCALE, ONE, SATURATION, SLOPE = 1000, 1_000_000_000, 12, 25
_NO_ID = np.iinfo(np.int64).max
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass
class Terms:
    """The terms of a slice of texts: lowered bytes, range and hash of each, and the first term of each text."""

    raw: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Terms:
        raw, at = utf8(column)
        body = np.concatenate([_TERM[raw], [False]])
        edge = np.ones(len(raw) + 1, bool)
        edge[1:] = ~body[:-1]
        edge[at] = True  # a text's start, or the end of all
        starts = np.flatnonzero(body & edge)
        last = np.ones(len(raw) + 1, bool)
        last[:-1] = ~body[1:]
        last[at[1:] - 1] = True  # a text's last byte; of an empty one, that of another, or one past all
        lengths = np.flatnonzero(body & last) + 1 - starts
        raw = _LOWER[raw]
        return cls(raw, starts, lengths, segment_hashes(raw, starts, lengths), np.searchsorted(starts, at))

    def bytes(self) -> list[bytes]:
        whole = self.raw.tobytes()
        return [whole[a : a + n] for a, n in zip(self.starts.tolist(), self.lengths.tolist(), strict=True)]


class Dictionary:
    """Terms of a block of items, found by hash and then by their bytes."""

    def __init__(self, terms: list[bytes]):
        lengths = np.fromiter(map(len, terms), np.int64, len(terms))
        raw = np.frombuffer(b"".join(terms), np.uint8)
        starts = np.cumsum(lengths) - lengths
        hashes = segment_hashes(raw, starts, lengths)
        order = np.argsort(hashes, kind="stable")
        self.raw, self.starts, self.lengths, self.hashes, self.number = raw, starts[order], lengths[order], hashes[order], order
        _, runs = np.unique(hashes, return_counts=True)
        self.longest_run = int(runs.max(initial=0))  # terms that share a hash; one, but for an unheard-of chance

    def find(self, t: Terms) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``t`` of terms that are known, ascending, and their numbers."""
        found = np.full(len(t.hashes), -1, np.int64)
        at = np.searchsorted(self.hashes, t.hashes)
        for k in range(self.longest_run):
            here = at + k
            maybe = np.flatnonzero((here < len(self.hashes)) & (found < 0))
            same = (self.hashes[here[maybe]] == t.hashes[maybe]) & (self.lengths[here[maybe]] == t.lengths[maybe])
            maybe = maybe[same]
            if not len(maybe):
                continue
            own, n = here[maybe], t.lengths[maybe]
            first = np.cumsum(n) - n
            within = np.arange(int(n.sum())) - np.repeat(first, n)
            equal = self.raw[np.repeat(self.starts[own], n) + within] == t.raw[np.repeat(t.starts[maybe], n) + within]
            whole = np.logical_and.reduceat(equal, first)
            found[maybe[whole]] = self.number[own[whole]]
        where = np.flatnonzero(found >= 0)
        return where, found[where]


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term binary, times`` of ``items(item_id, text)``; rows of one item add up, those without an id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            t = Terms.of(part.column(1))
            owner = np.repeat(np.arange(part.num_rows), np.diff(t.first))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(t.bytes(), pa.binary())], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", "text").where("item_id is not null and text is not null").mapInArrow(run, f"item_id {kind}, term binary")
    return found.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def term_matrix(docs: DataFrame, dictionary: Dictionary) -> DataFrame:
    """``doc_id, n, terms, counts`` of every document with a term: n of them in all, those of the dictionary and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(dictionary.hashes))
        for part in sliced(batches, "text"):
            t = Terms.of(part.column(1))
            n = np.diff(t.first)
            where, number = dictionary.find(t)
            doc = np.searchsorted(t.first, where, "right") - 1
            key, counts = np.unique(doc * size + number, return_counts=True)
            at = np.searchsorted(key, np.arange(part.num_rows + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(np.int32))) for values in (key % size, counts)]
            batch = pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"])
            yield batch.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").where("text is not null").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Product:
    """A block of items against documents: merges rows, and keeps the k best documents of each item."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, total: int, k: int):
        self.rows, self.weights, self.n_docs, self.total, self.k = rows, weights, n_docs, total, k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in rows]

    def meet(self, ids: np.ndarray, n: np.ndarray, at: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Take in documents: their ids, lengths, and from ``at[i]`` on to ``at[i + 1]`` the terms and counts of the i-th."""
        doc = np.repeat(np.arange(len(ids)), np.diff(at))
        m = 100 - SLOPE + (SLOPE * n * self.n_docs) // self.total
        impact = self.weights[terms] * ((ONE * counts) // (SCALE * counts + SATURATION * m[doc]))
        order = np.argsort(terms, kind="stable")
        terms, doc, impact = terms[order], doc[order], impact[order]
        own, first = np.unique(terms, return_index=True)
        first = np.append(first, len(terms))
        row = np.full(len(self.weights), -1, np.int64)
        row[own] = np.arange(len(own))
        score = np.zeros(len(ids), np.int64)
        for i, (asked, times) in enumerate(self.rows):
            there = row[asked]
            for r, f in zip(there[there >= 0].tolist(), times[there >= 0].tolist(), strict=True):
                a, b = first[r], first[r + 1]
                score[doc[a:b]] += f * impact[a:b]  # a term has one entry for a document, so none is met twice
            self._keep(i, ids, score)
            score[:] = 0

    def _keep(self, i: int, ids: np.ndarray, score: np.ndarray) -> None:
        old_ids, old_score = self.best[i]
        least = old_score[-1] if len(old_score) == self.k else 1
        new = np.flatnonzero(score >= least)
        if len(new) > self.k:  # leave out what k better ones of this block stand before
            edge = np.partition(score[new], len(new) - self.k)[len(new) - self.k]
            new = new[score[new] >= edge]
        if len(new):
            ids, score = np.concatenate([old_ids, ids[new]]), np.concatenate([old_score, score[new]])
            order = np.lexsort((ids, -score))[: self.k]
            self.best[i] = ids[order], score[order]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the item, id and score of all that are kept."""
        sizes = [len(ids) for ids, _ in self.best]
        none = np.zeros(0, np.int64)
        return np.repeat(np.arange(len(sizes)), sizes), np.concatenate([none, *(b[0] for b in self.best)]), np.concatenate([none, *(b[1] for b in self.best)])


def rank_block(matrix: DataFrame, rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """``item int, doc_id, score, part``: the k best documents of each item in each task; ``part`` is one of its task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        product = Product(rows, weights, n_docs, total, k)
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(_NO_ID))
            n, terms, counts = np.asarray(batch.column(1)), batch.column(2), batch.column(3)
            at = np.asarray(terms.offsets).astype(np.int64)
            at, terms, counts = at - at[0], np.asarray(terms.flatten()), np.asarray(counts.flatten()).astype(np.int64)
            low = 0
            while low < len(ids):
                high = min(low + BLOCK_DOCS, max(low + 1, int(np.searchsorted(at, at[low] + BLOCK_TERMS, "right")) - 1))
                a, b = at[low], at[high]
                product.meet(ids[low:high], n[low:high], at[low : high + 1] - a, terms[a:b], counts[a:b])
                low = high
        item, ids, score = product.found()
        task = TaskContext.get().partitionId() % PARTS  # type: ignore[union-attr]
        arrays = [pa.array(item.astype(np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(score), pa.array(np.full(len(item), task, np.int32))]
        yield pa.RecordBatch.from_arrays(arrays, ["item", "doc_id", "score", "part"])

    return matrix.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item int, doc_id long, score long, part int")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    Documents with a score above 0 alone, the highest first, equal ones by ascending doc_id. Null texts, and texts without terms,
    count nowhere; rows that repeat a doc_id are documents of their own, in any order among themselves if all else is equal; those
    without an id rank after others of their score. Rows that repeat an item_id add up to one item; those without one are left
    out. An item without terms, or whose terms no document has, has no rows; empty tables give none. Other columns are ignored.

    The driver holds one block of items at a time (``ITEM_BYTES``) and two numbers for each of its terms. Each further block is
    one more pass over the documents.
    """
    docs = with_long_id(docs.select("doc_id", "text"))
    asked = materialize(item_terms(items), "item-terms")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 60), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(1, -(-size // ITEM_BYTES))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = None
    for b in range(blocks):
        found = _search_block(docs, asked.where(block == b), k)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark, kind = docs.sparkSession, asked.schema["item_id"].dataType
    table = asked.sort("item_id", "term").toArrow()
    names = pc.unique(table["term"]).sort() if table.num_rows else pa.array([], pa.binary())
    number = np.asarray(pc.index_in(table["term"], names).combine_chunks()).astype(np.int64)
    ids = pc.unique(table["item_id"])
    owner = np.asarray(pc.index_in(table["item_id"], ids).combine_chunks())
    times, at = np.asarray(table["times"].combine_chunks()), np.searchsorted(owner, np.arange(len(ids) + 1))
    rows = [(number[a:b], times[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    matrix = materialize(term_matrix(docs, Dictionary(names.to_pylist())), "term-matrix")
    n_docs, total = matrix.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r.term: r["count"] for r in matrix.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(names))], np.int64)
    best = rank_block(matrix, rows, weights, n_docs, max(1, total), k)
    for by in (["item", "part"], ["item"]):  # an item has k rows from each task: first cut within parts of them, then in all
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    known = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int32()), "item_id": ids}), f"item int, item_id {kind.simpleString()}")
    return best.join(F.broadcast(known), "item").select("item_id", "rank", "doc_id", "score")
