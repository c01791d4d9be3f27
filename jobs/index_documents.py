"""Incremental indexing: a stream over a folder of document tables that chunks, embeds and counts what is new or changed.

    spark-submit jobs/index_documents.py --source <folder> --target <folder> --checkpoint <folder> [--config jobs/index_documents.json]

Each run takes the files that have come since the last one (``availableNow``), and ends. A document is known by its ``doc_id``: if
its text is that of the last version it is left out; otherwise its chunks take the place of the older ones; a null text removes
it. Of several rows of one document in a batch the one of the latest file counts, and of those with one time, the greatest hash.

    target/chunks/batch=<n>/lang=<lang>/     chunks with vectors, lengths and term counts
    target/terms/batch=<n>/                  what the batch adds to the terms' document frequencies
    target/documents/batch=<n>/lang=<lang>/  id, path, hash, and whether the document is there

A batch writes folders of its own and replaces them if it is run again, ``documents`` last, so a batch that was cut off counts
for nothing until it has been repeated. :func:`current_chunks` reads what is in force.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florilege.functions.text import short_id
from florilege.operators.chunk import chunk_documents
from florilege.operators.inverted import term_statistics
from florilege.schema import CHUNKS, ChunkOptions
from jobs import config

log = logging.getLogger("jobs.index_documents")
DEFAULTS = {"chunk_words": 220, "overlap_words": 40, "files_per_batch": 64}
#: Ids up to which a side of a join is broadcast, after a count.
BROADCAST_IDS = 100_000
LOG = T.StructType([*(T.StructField(n, T.StringType()) for n in ("id", "path", "hash")), T.StructField("there", T.BooleanType()), T.StructField("batch", T.LongType()), T.StructField("lang", T.StringType())])
STORED = T.StructType([*CHUNKS.fields, T.StructField("batch", T.LongType()), T.StructField("lang", T.StringType())])


def _among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` semi- or anti-joined with ``ids(id)``; texts are moved only if the ids are too many to be broadcast."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "id", how)


def _latest(rows: DataFrame) -> DataFrame:
    """One row for each id; only ids are shuffled, and the rows of those that come more than once."""
    several = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    order = Window.partitionBy("id").orderBy(F.col("modified").desc(), F.col("hash").desc_nulls_last())
    picked = _among(rows, several, "left_semi").withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
    return _among(rows, several, "left_anti").unionByName(picked)


def _log(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The last entry of each document, or the last before a batch."""
    try:
        rows = spark.read.schema(LOG).parquet(f"{target}/documents")
    except Exception as e:  # a first run has no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], LOG)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.groupBy("id").agg(F.max_by(F.struct("path", "hash", "there", "batch", "lang"), "batch").alias("last")).select("id", "last.*")


def _index(rows: DataFrame, number: int, target: str, options: ChunkOptions) -> None:
    spark = rows.sparkSession
    path = F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = rows.where("doc_id is not null").select(short_id(path).alias("id"), path.alias("path"), "text", F.coalesce("lang", F.lit("unknown")).alias("lang"), "modified", F.sha2("text", 256).alias("hash"))
    latest = _latest(rows.persist())
    known = _log(spark, target, number).select("id", F.col("hash").alias("old_hash"), "there")
    # a null hash, of a text that is null, equals no stored one, but what is not there need not be removed again
    same = latest.select("id", "hash").join(known, "id", "left").where("(there and hash = old_hash) or (hash is null and coalesce(not there, true))").select("id")
    changed = _among(latest, same, "left_anti").persist()
    n_read, n_changed = rows.count(), changed.count()
    chunks = chunk_documents(changed.select("id", "path", "text", "lang"), options, keep=["lang"])
    chunks.write.mode("overwrite").partitionBy("lang").parquet(f"{target}/chunks/batch={number}")
    cut = spark.read.schema(STORED).option("basePath", f"{target}/chunks").parquet(f"{target}/chunks/batch={number}")
    term_statistics(cut).drop("bucket").write.mode("overwrite").parquet(f"{target}/terms/batch={number}")
    log_rows = changed.select("id", "path", "hash", F.col("hash").isNotNull().alias("there"), "lang")
    log_rows.write.mode("overwrite").partitionBy("lang").parquet(f"{target}/documents/batch={number}")
    log.info("batch %d: read %d rows; %d documents new, changed or removed; wrote %d chunks", number, n_read, n_changed, cut.count())
    changed.unpersist()
    rows.unpersist()


def _pattern(path: str) -> str:
    """A pattern for a path alone: the file stream takes folders, and patterns of folders and files, but no plain path of a file."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[]{}") else f"{path[:-1]}[{path[-1]}]"


def index_documents(spark: SparkSession, source: str, target: str, checkpoint: str, settings: dict | None = None) -> int:
    """Index what has come to ``source`` since the checkpoint; returns the number of rows read."""
    settings = {**DEFAULTS, **(settings or {})}
    options = ChunkOptions(settings["chunk_words"], settings["overlap_words"])
    schema = spark.read.parquet(source).schema
    for name, kind in (("doc_id", T.IntegralType), ("text", T.StringType), ("lang", T.StringType)):
        if name not in schema.names or not isinstance(schema[name].dataType, kind):
            raise ValueError(f"{source} has no column {name} of type {kind.__name__}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(_pattern(source))
    stream = stream.select("doc_id", "text", "lang", F.col("_metadata.file_modification_time").alias("modified"))
    query = stream.writeStream.foreachBatch(lambda rows, number: _index(rows, number, target, options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("%s: %d rows read, index in %s", source, read, target)
    return read


def current_chunks(spark: SparkSession, target: str) -> DataFrame:
    """Chunks of each document's last version: rows of the library's chunks, with ``lang``."""
    # a batch counts once it is in the log, and of its documents those that no later batch has; these alone are many, so the
    # others are taken away, and chunks stay where they are
    entries = spark.read.schema(LOG).parquet(f"{target}/documents").select("id", "batch", "there")
    newest = F.max_by(F.struct("batch", "there"), "batch")
    old = entries.groupBy("id").agg(newest.alias("last"), F.collect_set("batch").alias("batches"))
    gone = old.select(F.col("id").alias("document_id"), "last", F.explode("batches").alias("batch")).where("batch < last.batch or not last.there").select("document_id", "batch")
    batches = sorted(r.batch for r in entries.select("batch").distinct().collect())
    rows = spark.read.schema(STORED).parquet(f"{target}/chunks").where(F.col("batch").isin(batches))
    n = gone.limit(BROADCAST_IDS + 1).count()
    if n:
        rows = rows.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, ["document_id", "batch"], "left_anti")
    return rows.select(*CHUNKS.names, "lang")


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Index the documents that are new in a folder of Parquet tables.")
    for name, what in (("source", "folder of Parquet files with doc_id, text and lang"), ("target", "folder of the index"), ("checkpoint", "folder of what has been read")):
        parser.add_argument(f"--{name}", required=True, help=what)
    parser.add_argument("--config", help="JSON file; see jobs/index_documents.json")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("index-documents").getOrCreate()
    try:
        index_documents(spark, args.source, args.target, args.checkpoint, config.load(spark, args.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
