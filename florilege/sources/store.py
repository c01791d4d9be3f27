"""Collections on disk: Parquet tables in segments, each of which counts once Spark has marked its last table as written.

``<base>/<id>/<table>/segment=<name>/`` holds what one ingestion added: ``documents`` and ``chunks``, ``touched`` (ids of the
documents that it added, replaced or removed), ``postings`` and ``terms`` (see :mod:`florilege.operators.inverted`), and at last
``about``, one row of names and counts. A segment is in force if Spark's ``_SUCCESS`` stands beside its ``about``; there is no
other pointer, and nothing is ever replaced. So writers that overlap keep what each of them added, and a reader never sees half
of a segment. For each document the last segment that touched it counts, in the order of names, which begin with a number one
higher than any in force when the segment was finished; of two that were written at once, either may come last.

:meth:`CollectionStore.compact` writes many segments anew as one, which says what it stands for and comes before all others. The
folders it stands for go later, once no plan should read them any more. All goes through Spark's readers and writers and
Hadoop's listings, so the base may be in any store; Spark must be left to write its success marks.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florilege.operators.inverted import POSTINGS, TERMS, StoredIndex, clustered_postings, term_statistics
from florilege.schema import CHUNKS, DOCUMENTS, shaped


#: Segments of a collection beyond which they are written anew as one. Ids touched by all but the first (about 120 bytes each) up to
#: which they are broadcast; beyond, segments are written anew once those ids are more than the first segment's documents, so what
#: is written anew stays in proportion to what has been added. Seconds for which folders stay that a compaction stands for.
MOST_SEGMENTS, MOST_GONE, KEEP_SECONDS = 16, 2_000_000, 3600
_KINDS = {name: T.StructType(fields) for name, fields in {
    "documents": DOCUMENTS.fields, "chunks": CHUNKS.fields, "touched": [T.StructField("id", T.StringType())], "postings": POSTINGS.fields, "terms": TERMS.fields,
    "about": [T.StructField(n, t) for n, t in (("name", T.StringType()), ("root_path", T.StringType()), ("stands_for", T.ArrayType(T.StringType())), ("n_touched", T.LongType()), ("n_chunks", T.LongType()), ("total_dl", T.LongType()))],
}.items()}
_BUCKETED = ("postings", "terms")


class CorruptCollection(ValueError):
    """A collection's segment cannot be read, or lacks a table."""


def collection_id(name: str) -> str:
    """The first 16 hex digits of SHA-256 of the name."""
    return sha256(name.encode()).hexdigest()[:16]


@dataclass
class Collection:
    """A collection's metadata and tables."""

    id: str
    name: str
    root_path: str
    documents: DataFrame
    chunks: DataFrame
    #: The stored inverted index, and what was in force when the collection was loaded; none of one that has not been saved.
    index: StoredIndex | None = None
    version: tuple[str, ...] = ()

    @classmethod
    def new(cls, spark: SparkSession, name: str, root_path: str = "") -> Collection:
        return cls(collection_id(name), name, root_path, spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], CHUNKS))


@dataclass
class Delta:
    """Documents and chunks to add, and ``gone(id)``: the documents that they replace, or that are removed."""

    documents: DataFrame
    chunks: DataFrame
    gone: DataFrame


class CollectionStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._staged: list[str] = []

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()] if fs.exists(where) else []

    def _committed(self, cid: str) -> list[str]:
        """Names of all segments that have been written to the end."""
        about = f"{self.base}/{cid}/about"
        names = (n.removeprefix("segment=") for n in self._names(about) if n.startswith("segment="))
        fs, _ = self._fs(about)
        return sorted(n for n in names if fs.exists(self._fs(f"{about}/segment={n}/_SUCCESS")[1]))

    def exists(self, cid: str) -> bool:
        return bool(self._committed(cid))

    def list(self) -> list[str]:
        """Ids of all collections; a base that does not exist has none."""
        return sorted(n for n in self._names(self.base) if self.exists(n))

    def _read(self, cid: str, table: str, segments: Iterable[str]) -> DataFrame:
        """A table's rows in some segments, with the segment's name, and the bucket if there is one."""
        kind = T.StructType([*_KINDS[table].fields, T.StructField("segment", T.StringType()), *([T.StructField("bucket", T.IntegerType())] if table in _BUCKETED else [])])
        root = f"{self.base}/{cid}/{table}"
        return self.spark.read.schema(kind).option("basePath", root).parquet(*(f"{root}/segment={s}" for s in segments))

    def _in_force(self, cid: str) -> tuple[list[T.Row], list[T.Row]]:
        """``about`` of the segments that count, in their order, and of those that others stand for.

        Of several compactions that stand for none of each other, the one that stands for most counts; what another alone stands
        for is still there.
        """
        names = self._committed(cid)
        if not names:
            raise FileNotFoundError(f"no collection {cid}")
        try:
            about = sorted(self._read(cid, "about", names).collect(), key=lambda r: r.segment)  # a row for each segment
        except Exception as e:
            raise CorruptCollection(f"corrupt collection store {cid}: {e}") from e
        if sorted(r.segment for r in about) != names or any(r.name is None for r in about):
            raise CorruptCollection(f"corrupt collection store {cid}: a segment does not say what it is")
        whole = [r for r in about if r.stands_for is not None]
        replaced = {s for r in whole for s in r.stands_for}
        first = max((r for r in whole if r.segment not in replaced), key=lambda r: (len(r.stands_for), r.segment), default=None)
        covered = set(first.stands_for) if first else set()
        rest = [r for r in about if r.stands_for is None and r.segment not in covered]
        return ([first] if first else []) + rest, [r for r in about if r.segment in covered or (r.stands_for is not None and r is not first)]

    def version(self, cid: str) -> tuple[str, ...]:
        """Names of all segments; another tuple once anything has been saved."""
        return tuple(self._committed(cid))

    def load(self, cid: str) -> Collection:
        """The collection in force."""
        version = self.version(cid)
        live, _ = self._in_force(cid)
        names = [r.segment for r in live]
        for table in _KINDS:
            fs, _ = self._fs(self.base)
            for name in names:
                if not fs.exists(self._fs(f"{self.base}/{cid}/{table}/segment={name}")[1]):
                    raise CorruptCollection(f"corrupt collection store {cid}: no {table} in {name}")
        number = F.array_position(F.lit(names), F.col("segment")).cast("int")  # rows say it in four bytes instead of a name

        def read(table: str, segments: list[str]) -> DataFrame:
            return self._read(cid, table, segments).withColumn("segment", number)

        gone = None
        if len(names) > 1:
            touched = read("touched", names[1:]).groupBy(F.col("id").alias("gone_id")).agg(F.max("segment").alias("by_segment"))
            gone = F.broadcast(touched) if sum(r.n_touched for r in live[1:]) <= MOST_GONE else touched
        tables = {}
        for table, key in (("documents", "id"), ("chunks", "document_id")):
            rows = read(table, names)
            if gone is not None:
                rows = rows.join(gone, (F.col(key) == F.col("gone_id")) & (F.col("segment") < F.col("by_segment")), "left_anti")
            tables[table] = rows.select(*_KINDS[table].names)
        index = StoredIndex(read("postings", names), read("terms", names), read("chunks", names), sum(r.n_chunks for r in live), sum(r.total_dl for r in live), gone)
        return Collection(cid, live[0].name, live[0].root_path, tables["documents"], tables["chunks"], index, version)

    def _write(self, cid: str, name: str, meta: tuple[str, str], documents: DataFrame, chunks: DataFrame, removed: DataFrame | None, stands_for: list[str] | None) -> None:
        """All tables of a segment; the index is made from the chunks as written, and the last table puts the segment in force."""

        def put(table: str, rows: DataFrame) -> None:
            writer = rows.write.mode("overwrite")
            (writer.partitionBy("bucket") if table in _BUCKETED else writer).parquet(f"{self.base}/{cid}/{table}/segment={name}")

        put("documents", shaped(documents, DOCUMENTS))
        put("chunks", chunks.select(*CHUNKS.names))
        own = self._read(cid, "documents", [name]).select("id")
        put("touched", own if removed is None else own.unionByName(removed.select("id")).distinct())
        cut = self._read(cid, "chunks", [name])
        put("postings", clustered_postings(cut))
        put("terms", term_statistics(cut))
        n_chunks, total_dl = cut.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        n_touched = self._read(cid, "touched", [name]).count()
        put("about", self.spark.createDataFrame([(*meta, stands_for, n_touched, n_chunks, total_dl)], _KINDS["about"]).coalesce(1))

    def _next(self, cid: str) -> int:
        return 1 + max((int(n[1:11]) for n in self._committed(cid)), default=0)

    def _whole(self, collection: Collection, stands_for: list[str]) -> Collection:
        self._write(collection.id, f"c{self._next(collection.id):010d}-{uuid.uuid4().hex}", (collection.name, collection.root_path), collection.documents, collection.chunks, None, stands_for)
        return self.load(collection.id)

    def save(self, collection: Collection) -> Collection:
        """Write the whole collection as one segment instead of all there are; returns it as read back."""
        return self._whole(collection, self._committed(collection.id))

    def append(self, cid: str, delta: Delta, name: str | None = None) -> Collection:
        """Add a segment to a collection that exists, and compact it if that makes too many, or more ids touched than the first has.

        What other writers have added meanwhile stays. A ``name`` of the caller's (``s`` and ten digits first) makes a repeated
        call write the same segment again.
        """
        first = self._in_force(cid)[0][0]
        self._write(cid, name or f"s{self._next(cid):010d}-{uuid.uuid4().hex}", (first.name, first.root_path), delta.documents, delta.chunks, delta.gone, None)
        live, _ = self._in_force(cid)
        if len(live) > MOST_SEGMENTS or sum(r.n_touched for r in live[1:]) > max(MOST_GONE, live[0].n_touched):
            return self.compact(cid)
        return self.load(cid)

    def compact(self, cid: str, keep_seconds: float | None = None) -> Collection:
        """Write all that is in force as one segment, and delete folders that others stand for once they are ``keep_seconds`` old.

        Writers may append meanwhile: their segments are not stood for, and stay. Only what every compaction in force stands for is
        deleted, so that two of them at once lose nothing either.
        """
        live, covered = self._in_force(cid)
        out = self._whole(self.load(cid), sorted({r.segment for r in [*live, *covered]}))
        live, covered = self._in_force(cid)
        whole = [r for r in [*live, *covered] if r.stands_for is not None]
        replaced = {s for r in whole for s in r.stands_for}
        standing = [set(r.stands_for) for r in whole if r.segment not in replaced]
        old = time.time() - (KEEP_SECONDS if keep_seconds is None else keep_seconds)
        for name in set.intersection(*standing) if standing else ():
            fs, mark = self._fs(f"{self.base}/{cid}/about/segment={name}/_SUCCESS")
            if fs.exists(mark) and fs.getFileStatus(mark).getModificationTime() / 1000 <= old:
                for table in _KINDS:
                    if table != "about":
                        fs.delete(self._fs(f"{self.base}/{cid}/{table}/segment={name}")[1], True)
                fs.delete(mark.getParent(), True)
        return out

    def summaries(self) -> DataFrame:
        """``id, name, root_path, doc_count, chunk_count`` of all collections; those that cannot be read are left out.

        Documents and chunks are counted by collection in one pass over ids alone; the driver sees names.
        """
        about, found = [], {"documents": None, "chunks": None}
        for cid in self.list():
            try:
                c = self.load(cid)
            except CorruptCollection:
                continue
            about.append((cid, c.name, c.root_path))
            for table in found:
                ids = getattr(c, table).select(F.lit(cid).alias("id"))
                found[table] = ids if found[table] is None else found[table].unionByName(ids)
        out = self.spark.createDataFrame(about, "id string, name string, root_path string")
        for table, label in (("documents", "doc_count"), ("chunks", "chunk_count")):
            counts = found[table].groupBy("id").agg(F.count("*").alias(label)) if about else self.spark.createDataFrame([], f"id string, {label} long")
            out = out.join(counts, "id", "left")
        return out.fillna(0, ["doc_count", "chunk_count"])

    def staging(self, cid: str, label: str, rows: DataFrame) -> DataFrame:
        """``rows`` written once beside the tables and read back, until :meth:`clear`."""
        path = f"{self.base}/{cid}/staging-{uuid.uuid4().hex}/{label}"
        rows.write.parquet(path)
        self._staged.append(path.rpartition("/")[0])
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear(self) -> None:
        """Delete what this store has staged."""
        while self._staged:
            fs, where = self._fs(self._staged.pop())
            fs.delete(where, True)


def import_json(spark: SparkSession, path: str) -> Collection:
    """A collection from a single JSON file with ``collection``, ``documents`` and ``chunks``, the latter two keyed by id."""
    chunk = "id string, document_id string, document_path string, text string, start_offset long, end_offset long, page_number int, embedding array<float>"
    schema = f"collection struct<id:string,name:string,root_path:string>, documents map<string,struct<id:string,path:string,hash:string,mime_type:string,indexed_at:timestamp>>, chunks map<string,struct<{chunk.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)
    try:
        meta = rows.select("collection.*").first()
    except Exception as e:
        raise CorruptCollection(f"corrupt collection store {path}: {e}") from e
    if meta is None or meta.id is None:
        raise CorruptCollection(f"corrupt collection store {path}")
    from florilege.functions.text import tokens

    documents = rows.select(F.explode(F.map_values("documents")).alias("d")).select("d.*")
    chunks = rows.select(F.explode(F.map_values("chunks")).alias("c")).select("c.*").withColumn("toks", tokens(F.col("text")))
    terms = F.transform(F.array_distinct("toks"), lambda t: F.struct(t.alias("term"), F.size(F.filter("toks", lambda x: x == t)).alias("tf")))
    return Collection(meta.id, meta.name, meta.root_path, documents, chunks.withColumn("dl", F.size("toks")).withColumn("terms", terms).select(*CHUNKS.names))
