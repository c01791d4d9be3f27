"""A stored inverted index: postings as a Parquet table clustered by term, and partial statistics beside it.

``postings(bucket, term, document_id, chunk_id, tf, dl)`` is partitioned by a hash of the term and sorted by term within, so the
scan for a question reads the folders, and in them the pages, that may hold its terms. ``terms(bucket, term, df, max_tf, min_dl)``
has what a segment adds to a term's statistics. Both come in segments; rows of documents that a later segment has replaced or
removed are left out by their ids, and what they add to the statistics is taken off again: nothing is recounted for a question.

:meth:`StoredIndex.search` finds the k best chunks without scoring most postings (MaxScore): the rarest terms give a score that k
chunks reach; terms whose bounds together stay below it cannot bring a chunk among the k best by themselves, so their postings
count only for chunks that another term has found and that can still get there. The rows are those of an unpruned search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florilege.functions import scores
from florilege.operators.best import Best
from florilege.operators.keyword import BEST_QUESTIONS, BROADCAST_TERMS, Asked, postings, question_terms, ranked, scored_rows
from florilege.sources.folders import written

#: Folders of postings by hash of the term; terms up to which a scan is told them one by one; rare postings a wanted chunk that
#: the first bound is taken from; candidates with terms up to which they are broadcast; what sums of scores may be off by.
BUCKETS, LITERAL_TERMS, SEED_POSTINGS, BROADCAST_LOOKUPS, SLACK = 32, 256, 50, 500_000, 1e-6
#: Postings that are scored at a time for many questions; postings that a task sorts at a time, and gives on at a time.
SHARED_POSTINGS, SORTED_POSTINGS, _GIVEN = 500_000, 2_000_000, 1 << 16
POSTINGS = T.StructType([T.StructField(n, t) for n, t in (("term", T.StringType()), ("document_id", T.StringType()), ("chunk_id", T.StringType()), ("tf", T.IntegerType()), ("dl", T.IntegerType()))])
TERMS = T.StructType([T.StructField(n, t) for n, t in (("term", T.StringType()), ("df", T.LongType()), ("max_tf", T.IntegerType()), ("min_dl", T.IntegerType()))])


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def clustered_postings(chunks: DataFrame) -> DataFrame:
    """Rows of ``POSTINGS`` and their bucket, by bucket and term within each task: chunks stay where they are, and a common
    term is dealt over as many files as there are tasks.

    Terms are sorted by number, each spelled once, some million postings at a time; Spark then sorts by bucket alone, which is a
    stable sort of numbers. A task of more postings has several such runs in each bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(3).flatten())
            if size >= SORTED_POSTINGS:
                yield from _by_term(held)
                held, size = [], 0
        if size:
            yield from _by_term(held)

    rows = chunks.select("document_id", F.col("id").alias("chunk_id"), "dl", "terms").mapInArrow(run, POSTINGS)
    return rows.withColumn("bucket", bucket_of(F.col("term"))).sortWithinPartitions("bucket")


def _by_term(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings by term of chunks ``document_id, chunk_id, dl, terms``, in the chunks' order within a term."""
    document, chunk, dl, terms = (pa.chunked_array(c).combine_chunks() for c in zip(*(b.columns for b in batches), strict=True))
    flat = terms.flatten()
    row = np.repeat(np.arange(len(terms)), np.asarray(terms.value_lengths().fill_null(0)))
    term = flat.field("term").dictionary_encode()
    rank = np.empty(len(term.dictionary), np.int32)
    rank[np.asarray(pc.array_sort_indices(term.dictionary))] = np.arange(len(rank))
    order = np.argsort(rank[np.asarray(term.indices)], kind="stable")
    for low in range(0, len(order), _GIVEN):
        at, own = (pa.array(x) for x in (order[low : low + _GIVEN], row[order[low : low + _GIVEN]]))
        yield pa.RecordBatch.from_arrays([term.dictionary.take(term.indices.take(at)), document.take(own), chunk.take(own), flat.field("tf").take(at), dl.take(own)], POSTINGS.names)


def term_statistics(chunks: DataFrame) -> DataFrame:
    """Rows of ``TERMS`` and their bucket, by bucket and term; counted on both sides of the shuffle."""
    rows = postings(chunks).groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    return rows.withColumn("bucket", bucket_of(F.col("term"))).repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term")


@dataclass
class StoredIndex:
    """Postings and statistics in segments, and ``gone(gone_id, by_segment)``: documents that a later segment has taken from earlier ones.

    ``segment`` and ``by_segment`` are numbers in the order of segments.

    ``chunks`` are asked only for the lengths of what is gone. ``n`` and ``total_dl`` count all segments' chunks, those gone too.
    """

    stored_postings: DataFrame
    stored_terms: DataFrame
    chunks: DataFrame
    n: int
    total_dl: int
    gone: DataFrame | None = None
    scored: Callable[[str, DataFrame], DataFrame] = lambda what, rows: rows  # for tests: sees the postings that are scored

    def _asked(self, rows: DataFrame, terms: DataFrame) -> DataFrame:
        """Rows of the terms: a few are named to the scan, so that it reads their pages alone; more are joined, by folder first."""
        few = [r.term for r in terms.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
        if len(few) > LITERAL_TERMS:
            own = terms.select("term").distinct().withColumn("bucket", bucket_of(F.col("term")))
            # in parts of a size that is broadcast, so that no common term gathers in one task
            parts = 1 + own.count() // (BROADCAST_TERMS * 4 // 5)
            part = F.pmod(F.xxhash64("term", F.lit(7)), F.lit(parts))
            return reduce(DataFrame.unionByName, (rows.join(F.broadcast(own.where(part == p)), ["bucket", "term"]) for p in range(parts)))
        if not few:
            return rows.where(F.lit(False))
        spark = rows.sparkSession
        folders = sorted({r.b for r in spark.createDataFrame([(t,) for t in few], "term string").select(bucket_of(F.col("term")).alias("b")).collect()})
        return rows.where(F.col("bucket").isin(folders)).where(reduce(lambda a, b: a | b, (F.col("term") == t for t in few)))

    def _live(self, rows: DataFrame) -> DataFrame:
        if self.gone is None:
            return rows
        return rows.join(self.gone, (F.col("document_id") == F.col("gone_id")) & (F.col("segment") < F.col("by_segment")), "left_anti")

    def _dead(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.gone, (F.col("document_id") == F.col("gone_id")) & (F.col("segment") < F.col("by_segment")), "left_semi")

    def postings(self, terms: DataFrame) -> DataFrame:
        """``term, chunk_id, tf, dl`` of the distinct terms of ``terms(term)``."""
        return self._live(self._asked(self.stored_postings, terms)).select("term", "chunk_id", "tf", "dl")

    def corpus_stats(self) -> tuple[int, int]:
        """Number of chunks, and of their tokens."""
        if self.gone is None:
            return self.n, self.total_dl
        lost = self._dead(self.chunks.select("document_id", "segment", "dl")).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        return self.n - lost.n, self.total_dl - lost.dl

    def document_frequency(self, terms: DataFrame) -> DataFrame:
        """``term, df, max_tf, min_dl`` of those terms that occur; the last two are bounds once documents have gone."""
        added = self._asked(self.stored_terms, terms).select("term", "df", "max_tf", "min_dl")
        if self.gone is not None:
            lost = self._dead(self._asked(self.stored_postings, terms)).groupBy("term").agg((-F.count("*")).alias("df"))
            added = added.unionByName(lost.select("term", "df", F.lit(None).cast("int").alias("max_tf"), F.lit(None).cast("int").alias("min_dl")))
        return added.groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")).where("df > 0")

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        """``query_id, chunk_id, score, rank`` of the k best chunks of each of ``questions(query_id, text)``, ties by chunk id.

        Weights of at most 100,000 terms of questions pass through the driver; beyond that the questions are taken in parts.
        """
        asked = question_terms(questions)
        size = asked.count()
        parts = max(1, -(-size * 5 // (4 * BROADCAST_TERMS))) if size > BROADCAST_TERMS else 1
        n, total = self.corpus_stats()
        out = None
        for p in range(parts):
            some = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p)
            found = self._search(some, k, n, total / n if n else 0.0)
            out = found if out is None else out.unionByName(found)
        return out

    def _search(self, asked: DataFrame, k: int, n: int, avg_dl: float) -> DataFrame:
        spark = asked.sparkSession
        idf = scores.idf(F.lit(n), F.col("df"))
        bound = scores.bm25(F.col("idf"), F.col("max_tf"), F.col("min_dl"), F.lit(avg_dl))
        weights = asked.join(F.broadcast(self.document_frequency(asked)), "term").withColumn("idf", idf).select("query_id", "term", "df", "idf", bound.alias("bound"))
        rows = weights.collect()
        if not rows or k <= 0:
            return spark.createDataFrame([], T.StructType([asked.schema["query_id"], T.StructField("chunk_id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
        by_query: dict = {}
        for r in rows:
            by_query.setdefault(r.query_id, []).append(r)
        kind = asked.schema["query_id"].dataType.simpleString()

        def table(chosen: list) -> DataFrame:
            return spark.createDataFrame([(r.query_id, r.term, r.idf) for r in chosen], f"query_id {kind}, term string, idf double")

        def summed(what: str, chosen: list) -> DataFrame:
            """The part of each chunk's score that comes from some terms of its question."""
            own = table(chosen)
            hits = self.scored(what, self.postings(own).join(F.broadcast(own), "term"))
            return hits.groupBy("query_id", "chunk_id").agg(F.sum(scores.bm25(F.col("idf"), F.col("tf"), F.col("dl"), F.lit(avg_dl))).alias("part"))

        seeds = []
        for own in by_query.values():
            seen = 0
            for r in sorted(own, key=lambda r: (r.df, r.term)):
                if seen >= SEED_POSTINGS * k:
                    break
                seeds.append(r)
                seen += r.df
        reached = ranked(summed("seed", seeds).withColumnRenamed("part", "score"), k).where(F.col("rank") == k)
        floor = {r.query_id: r.score - SLACK for r in reached.select("query_id", "score").collect()}
        leading, following, rest = [], [], []
        for q, own in by_query.items():
            least, below = floor.get(q, 0.0), 0.0
            for r in sorted(own, key=lambda r: (r.bound, r.term)):
                if below + r.bound < least:
                    below += r.bound
                    following.append(r)
                else:
                    leading.append(r)
            rest.append((q, below, least))
        distinct = {r.term: r.df for r in rows}
        # many questions with terms in common: a posting is moved once for all of them, if that is less than for each of them
        if sum(r.df for r in leading) > sum(distinct.values()) and len(by_query) <= BEST_QUESTIONS:
            return self._shared(Asked(rows), asked, k, avg_dl, {r.term: r.idf for r in rows}, sum(distinct.values()))
        first = summed("leading", leading)
        if not following:
            return ranked(first.withColumnRenamed("part", "score"), k).select("query_id", "chunk_id", "score", "rank")
        limits = F.broadcast(spark.createDataFrame(rest, f"query_id {kind}, rest double, least double"))
        open_ = written(first.join(limits, "query_id").where("part + rest >= least").select("query_id", "chunk_id", "part"), "candidates")
        wanted = open_.select("query_id", "chunk_id").join(F.broadcast(table(following)), "query_id")
        small = wanted.limit(BROADCAST_LOOKUPS + 1).count() <= BROADCAST_LOOKUPS
        hits = self.postings(table(following)).join(F.broadcast(wanted) if small else wanted, ["term", "chunk_id"])
        more = self.scored("following", hits).select("query_id", "chunk_id", scores.bm25(F.col("idf"), F.col("tf"), F.col("dl"), F.lit(avg_dl)).alias("part"))
        whole = open_.unionByName(more).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))
        return ranked(whole, k).select("query_id", "chunk_id", "score", "rank")

    def _shared(self, asked: Asked, questions: DataFrame, k: int, avg_dl: float, idf: dict[str, float], size: int) -> DataFrame:
        """The k best chunks of all questions: postings are dealt out by chunk, and a part of the chunks is scored at a time."""
        asked.avg_dl, asked.idf = avg_dl, np.array([idf[t] for t in asked.terms])
        hits = self.scored("shared", self.postings(questions.sparkSession.createDataFrame([(t,) for t in asked.terms], "term string")))
        parts = max(1, -(-size // SHARED_POSTINGS))
        dealt = hits.groupBy(F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).alias("part"))
        schema, made = scored_rows(asked, questions)

        def best(table: pa.Table) -> pa.Table:
            chunk = table["chunk_id"].combine_chunks().dictionary_encode()
            order = np.argsort(np.asarray(chunk.indices), kind="stable")
            own = np.asarray(chunk.indices)[order]
            at = np.asarray(pc.index_in(table["term"].combine_chunks(), value_set=pa.array(asked.terms)))[order]
            tf, dl = (np.asarray(table[c].combine_chunks())[order] for c in ("tf", "dl"))
            kept = Best(len(asked.ids), k)
            step = asked.step()
            for low in range(0, len(chunk.dictionary), step):
                a, b = np.searchsorted(own, [low, low + step])
                names = chunk.dictionary.slice(low, step)
                kept.meet(names, asked.sums(own[a:b] - low, at[a:b], tf[a:b], dl[a:b], len(names)))
            return pa.Table.from_batches([made(*kept.found())])

        return ranked(dealt.applyInArrow(best, schema), k)
