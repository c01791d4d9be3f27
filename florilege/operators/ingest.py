"""Incremental ingestion: the difference between a folder and what is stored, by content hash."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florilege.functions.text import mime_type, short_id
from florilege.operators.chunk import DIM
from florilege.operators.chunk_ranges import chunk_all
from florilege.schema import CHUNKS, DOCUMENTS, ChunkOptions, shaped
from florilege.sources.files import BINARY_PARSERS, Files, Folder, parse_binary, parse_text, parser_of
from florilege.sources.folders import BROADCAST_IDS, written
from florilege.sources.pdf import OcrEngine
from florilege.sources.store import Collection, Delta

#: Microseconds by which the clocks of a file system and of the driver may differ.
CLOCK_MICROS = 2_000_000
#: Buckets of ids that a collection and a folder are compared by.
BUCKETS = 4096
_HASHED = T.StructType([T.StructField("path", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("error", T.StringType()), T.StructField("modified", T.LongType()), T.StructField("length", T.LongType())])
STATUSES = ("added", "updated", "unchanged", "skipped", "error", "removed")


def snapshot_diff(disk: DataFrame, stored: DataFrame, keep_outside: str | None = None) -> DataFrame:
    """``id, path, hash, status`` by a full outer join of ``disk(id, path, hash)`` with ``stored(id, path, hash)``.

    Status is added, updated, unchanged or removed. With ``keep_outside``, only stored paths under that root are removed.
    """
    s = stored.select(F.col("id").alias("old_id"), F.col("path").alias("old_path"), F.col("hash").alias("old_hash"))
    both = disk.select("id", "path", "hash").join(s, F.col("id") == F.col("old_id"), "full_outer")
    gone = F.lit("removed")
    if keep_outside is not None:
        gone = F.when(F.startswith("old_path", F.lit(keep_outside.rstrip("/") + "/")), "removed").otherwise("unchanged")
    status = F.when(F.col("id").isNull(), gone).when(F.col("old_id").isNull(), "added").when(F.col("hash") == F.col("old_hash"), "unchanged").otherwise("updated")
    return both.select(F.coalesce("id", "old_id").alias("id"), F.coalesce("path", "old_path").alias("path"), F.coalesce("hash", "old_hash").alias("hash"), status.alias("status"))


def equal_buckets(disk: DataFrame, stored: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket``: buckets of ids that hold the same ids with the same hashes on both sides, by their numbers and two 64-bit digests.

    Digests are added up where the rows are; what is joined is a row for each bucket and side.
    """

    def digests(rows: DataFrame) -> DataFrame:
        both = F.expr("bit_xor(xxhash64(id, hash))").alias("a"), F.expr("bit_xor(xxhash64(hash, id, 7))").alias("b")
        return rows.groupBy(_bucket(buckets).alias("bucket")).agg(F.count("*").alias("n"), *both)

    return digests(disk).join(digests(stored), ["bucket", "n", "a", "b"]).select("bucket")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(11)), F.lit(buckets))


def digest_diff(disk: DataFrame, stored: DataFrame, equal: DataFrame, keep_outside: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of :func:`snapshot_diff`, where ids of ``equal(bucket)`` buckets, of which there are ``buckets`` at most, aren't joined.

    So what is shuffled follows what has changed: of a collection with few changes, most rows stay where they are.
    """
    equal = F.broadcast(equal)
    within = lambda rows, how: rows.withColumn("bucket", _bucket(buckets)).join(equal, "bucket", how).drop("bucket")
    same = within(disk.select("id", "path", "hash"), "left_semi").withColumn("status", F.lit("unchanged"))
    return same.unionByName(snapshot_diff(within(disk, "left_anti"), within(stored, "left_anti"), keep_outside))


@dataclass
class IngestResult:
    """The new state, a report of ``path, status, error`` with one row per file or removed document in path order, and what is new."""

    collection: Collection
    report: DataFrame
    delta: Delta

    def counts(self) -> dict[str, int]:
        found = {r["status"]: r["count"] for r in self.report.groupBy("status").count().collect()}
        return {s: found.get(s, 0) for s in STATUSES}


def _hashes(source: Folder | Files, claimed: DataFrame, stored: DataFrame) -> DataFrame:
    """``path, hash, error`` and, where a listing says them, ``modified, length`` of the claimed files.

    A file whose time and length are those of the stored document, and whose time was past when that was read by more than the
    clocks may differ, keeps its hash unopened; all others are opened.
    """
    if "modified" not in claimed.columns:
        return shaped(source.hashes(claimed), _HASHED)
    known = shaped(stored, DOCUMENTS).where(F.col("modified") + CLOCK_MICROS < F.unix_micros("indexed_at")).select("path", "modified", "length", F.col("hash").alias("known_hash"))
    marked = claimed.join(known, ["path", "modified", "length"], "left")
    same = marked.where("known_hash is not null").withColumn("hash", F.col("known_hash"))
    return shaped(same, _HASHED).unionByName(shaped(source.hashes(marked.where("known_hash is null").drop("known_hash")), _HASHED))


def ingest(collection: Collection, files: DataFrame | Folder | Files, options: ChunkOptions = ChunkOptions(), dim: int = DIM, ocr: OcrEngine | None = None, prune_root: str | None = None, stage: Callable[[DataFrame, str], DataFrame] = written, columns: Sequence[str] = tuple(CHUNKS.names)) -> IngestResult:
    """Bring a collection up to date with files: a table ``path, content, error``, or a folder or store of them.

    Files that no parser claims are skipped; unchanged ones are not parsed. A document that fails to parse keeps its old
    version and is tried again next time. Stored documents that are not among the files, or could not be read, or are no
    longer claimed, are removed: all of them, or with ``prune_root`` those under that root only. The result is a plan; nothing
    is written to the collection until it is saved.

    Hashes are compared first: by digests of buckets of ids, and then, in those buckets that differ, one by one; a file that its folder lists with the time and
    length of the stored document is not opened. Then added and updated files alone are read
    again and parsed, once; their hashes are those of what was parsed. ``stage`` keeps the tables of hashes, of what is to be read,
    of parsed files and of what is gone, so that all that follows sees the same rows; by default they are written to the shared
    folder. Chunks of documents that stay are not moved to meet what is gone, unless that is more than ``BROADCAST_IDS``.
    ``columns`` of chunks are made and kept: all of them for a collection that is to be saved.
    """
    source = Files(files) if isinstance(files, DataFrame) else files
    claimed = source.paths(stage).withColumn("parser", parser_of(F.col("path"), ocr is not None))
    skipped = claimed.where("parser is null").select("path", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"))
    hashed = stage(_hashes(source, claimed.where("parser is not null"), collection.documents).withColumn("id", short_id(F.col("path"))), "hashes")
    unread = hashed.where("hash is null").select("path", F.lit("error").alias("status"), "error")
    there = hashed.where("hash is not null")
    equal = stage(equal_buckets(there, collection.documents), "equal-buckets")
    diff = digest_diff(there, collection.documents, equal, prune_root)
    listed = hashed.select("id", "modified", "length")
    todo = diff.where(F.col("status").isin("added", "updated")).select("id", "path", F.col("status").alias("fresh_status"), parser_of(F.col("path"), ocr is not None).alias("parser")).join(listed, "id")
    todo = stage(todo, "todo")
    binary = F.col("parser").isin(BINARY_PARSERS)
    fresh = lambda some: source.read(todo.where(some)).withColumn("hash", F.sha2("content", 256))
    parsed = parse_text(fresh(~binary)).unionByName(parse_binary(fresh(binary), ocr))
    parsed = stage(parsed.drop("parser"), "parsed")
    failed = parsed.where("error is not null").select("path", F.lit("error").alias("status"), "error")
    good = parsed.where("error is null")
    documents = good.select("id", "path", "hash", mime_type(F.col("path")).alias("mime_type"), F.current_timestamp().alias("indexed_at"), "modified", "length")
    gone = diff.where("status = 'removed'").select("id").unionByName(good.where("fresh_status = 'updated'").select("id"))
    gone = stage(gone, "gone")
    lost = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept_documents = collection.documents.join(lost, "id", "left_anti")
    kept_chunks = collection.chunks.join(lost.withColumnRenamed("id", "document_id"), "document_id", "left_anti")
    chunks = chunk_all(good.select("id", "path", "text", "boundaries"), options, dim, columns)
    done = good.select("path", F.col("fresh_status").alias("status"), F.lit(None).cast("string").alias("error"))
    same = diff.where(F.col("status").isin("unchanged", "removed")).select("path", "status", F.lit(None).cast("string").alias("error"))
    report = done.unionByName(same).unionByName(skipped).unionByName(unread).unionByName(failed).orderBy("path", "status")
    new = Collection(collection.id, collection.name, collection.root_path, shaped(kept_documents, DOCUMENTS).unionByName(documents), kept_chunks.select(*columns).unionByName(chunks))
    return IngestResult(new, report, Delta(documents, chunks, gone))
