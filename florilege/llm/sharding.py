"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash. It starts as one bucket; only a bucket over the byte limit splits, on one
more bit, until every shard fits. The shard of a row is thus its shortest hash prefix whose rows fit the limit.

The directory is a Spark table. Bytes are added up by a prefix somewhat longer than a full shard's (the *leaves*, pre-aggregated
in the tasks), and from there for all shorter prefixes at once. Rows of leaves that are over the limit themselves are counted
again with more bits, those rows alone. The driver holds the total of bytes and the number of such leaves, nothing per shard.

The first 32 bits hash the doc_id; the other 28 hash the row's place too, so even rows that repeat one id can be told apart. The
hashes are written once, and all later steps read them there: a source that deals its rows otherwise when read again makes no
difference.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.storage import materialize

SHARD_BYTES = 8 << 20
#: Bits of a leaf beyond those of an average full shard; bits added in each later count; all bits.
LEAF_BITS, MORE_BITS, ALL_BITS = 2, 8, 60
#: Entries of a table, of some tens of bytes each, up to which it is broadcast.
BROADCAST_ENTRIES = 1 << 16


def _hash(columns: list[str], doc_id: str, text: str, name: str, size: str) -> list:
    """The columns, the hash and the bytes of a row."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    place = F.md5(F.concat_ws("/", key, F.monotonically_increasing_id().cast("string")))
    high = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(place, 1, 7), 16, 10).cast("long")
    n = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    return [*columns, n.alias(size), F.shiftleft(high, 28).bitwiseOR(low).alias(name)]


def _prefix(bits: int):
    return F.shiftright("h", ALL_BITS - bits)


def _small(table: DataFrame, most: int) -> DataFrame:
    return F.broadcast(table) if table.count() <= most else table


def _levels(leaves: DataFrame, bits: int, low: int, limit: int) -> DataFrame:
    """``depth, prefix, bytes, docs, fits`` of the buckets of depth ``low`` to ``bits`` over ``leaves(p, bytes, docs)`` of ``bits`` bits."""
    rows = leaves.select("p", "bytes", "docs", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("depth"))
    by = rows.groupBy("depth", F.expr(f"shiftright(p, {bits} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
    return by.withColumn("fits", (F.col("bytes") <= limit) | (F.col("docs") <= 1) | (F.col("depth") >= ALL_BITS))


def _shards(buckets: DataFrame, low: int) -> DataFrame:
    """The buckets that fit, but whose parent does not."""
    full = buckets.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    inner = buckets.where("fits").withColumn("up", F.shiftright("prefix", 1)).join(full, ["depth", "up"], "left_semi")
    top = buckets.where(F.col("fits") & (F.col("depth") == low))
    return inner.select("depth", "prefix", "bytes", "docs").where(F.col("depth") > low).unionByName(top.select("depth", "prefix", "bytes", "docs"))


def _placed(rows: DataFrame, limit: int, most: int) -> DataFrame:
    """Add ``depth, bytes, docs`` of its shard to each row of a written table ``rows(h, n_bytes, ...)``."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    full = math.ceil(math.log2(max(1, total / limit)))  # bits of shards, were all full
    low, bits, open_rows, out = 0, min(ALL_BITS, full + LEAF_BITS), rows, None
    while True:
        leaves = materialize(open_rows.groupBy(_prefix(bits).alias("p")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs")), "leaves")
        # buckets far above the leaves are added up from those half way
        mid = max(low, min(bits, full - LEAF_BITS))
        buckets = _levels(leaves, bits, mid, limit)
        if mid > low:
            at_mid = buckets.where(F.col("depth") == mid).select(F.col("prefix").alias("p"), "bytes", "docs")
            buckets = buckets.unionByName(_levels(at_mid, mid, low, limit).where(F.col("depth") < mid))
        buckets = materialize(buckets, "buckets")
        found = materialize(_shards(buckets, low), "shards")
        place = leaves.select("p", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("depth"))
        place = place.withColumn("prefix", F.expr(f"shiftright(p, {bits} - depth)")).join(found, ["depth", "prefix"]).drop("prefix")
        over = buckets.where((F.col("depth") == bits) & ~F.col("fits")).select(F.col("prefix").alias("p"))
        left = over.count()
        mine = open_rows
        if left:
            over = F.broadcast(over) if left <= most else over
            mine = open_rows.join(over, _prefix(bits) == F.col("p"), "left_anti")
        part = mine.join(_small(materialize(place, "directory"), most), _prefix(bits) == F.col("p")).drop("p")
        out = part if out is None else out.unionByName(part)
        if not left:
            return out
        open_rows = open_rows.join(over, _prefix(bits) == F.col("p"), "left_semi")
        low, bits = bits + 1, min(ALL_BITS, bits + MORE_BITS)


def _shard():
    return F.expr(f"substring(lpad(bin(h), {ALL_BITS}, '0'), 1, depth)")


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES, most: int = BROADCAST_ENTRIES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_bytes, depth, shard, shard_bytes, shard_docs``.

    ``shard`` is the hash prefix as a string of ``depth`` bits, empty for one shard of all. A null text has no bytes; a null
    doc_id hashes as an empty name; a document over the limit is alone in its shard. Repeated rows are dealt each, and other
    columns are ignored. An empty table gives no rows. The texts are read once and never shuffled; a directory of more than ``most`` entries is joined by
    hash prefix, a smaller one broadcast.
    """
    rows = materialize(docs.select(*_hash(["doc_id"], "doc_id", "text", "h", "n_bytes")), "hashes")
    placed = _placed(rows, limit, most)
    return placed.select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), _shard().alias("shard"), F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, most: int = BROADCAST_ENTRIES) -> str:
    """Write ``docs`` as Parquet, one folder per shard and one file in each; returns the folders' column.

    That column is ``shard``, with as many underscores after it as it takes to differ from every column of ``docs``, whatever
    the case. All rows are written once, those with null and repeated ids too; an empty table writes no shard. The
    documents are copied beside their hashes first, so that both belong to the same rows, and shuffled once, by shard.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, columns, strict=True))
    rows = materialize(docs.toDF(*columns).select(*_hash(columns, at["doc_id"], at["text"], "h", "n_bytes")), "shard-rows")
    name = "shard"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    out = _placed(rows, limit, most).select(*(F.col(c).alias(n) for c, n in zip(columns, docs.columns, strict=True)), _shard().alias(name))
    out.repartition(name).write.partitionBy(name).parquet(path)
    return name
