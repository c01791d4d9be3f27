"""N-gram Jaccard self-join: MinHash banding, then verification on full n-gram sets.

1. Every text becomes its set of word n-grams (64-bit hashes; a text of fewer words is one n-gram) and a signature of
   ``bands`` x ``rows`` minimum hashes, with the least numbers that reach the target recall at the threshold.
2. Documents with equal sets form a class; its least doc_id represents it. Only representatives go on.
3. Band hashes are shuffled. A bucket is led by its least member; a document's home is the least leader of its buckets, then
   twice the least home in its buckets, so near copies have one home or a few. Two homes are compared if a bucket has members of both: every pair that shares a band
   is then verified once, and a set is sent once for each home that its own is compared with, not once per band and pair.
   Homes are cut by the size of sets, into cells so wide that similar sets are in one or in two adjacent cells; only such are compared.
4. A cell is cut into blocks of bounded numbers of sets and of n-grams; each pair of blocks is a task that counts the common
   n-grams of its pairs. Tasks give back link counts and a spanning forest, never the pairs of a group. A cell of m different
   sets takes m^2 comparisons and m^2 / BLOCK copies of sets.
5. The forests' components are the near-duplicate classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.components import connected_components
from florilege.llm.hot import join_by_key
from florilege.llm.idfilter import split_by_ids
from florilege.llm.ids import with_long_id
from florilege.llm.storage import discard, materialize
from florilege.llm.textkernels import Words, mix, sliced, utf8
from florilege.llm.worker import begin

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Representatives of a block, and their n-grams on average; a task compares two blocks at most.
BLOCK, BLOCK_GRAMS = 256, 500_000
#: Cells of a bucket that one row lists; longer lists are cut and joined with each other.
LISTED = 500
#: Times that homes pass to the members of a bucket: large groups of near copies get one home, and chains stay cut in parts.
HOPS = 2
_SEED = 7


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 128) -> tuple[int, int]:
    """Bands and rows: the most rows per band (fewest false candidates) that reach ``recall`` at ``threshold``."""
    for rows in range(32, 0, -1):
        bands = 1
        if threshold < 1:
            bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most_hashes:
            return max(1, bands), rows
    raise ValueError("no banding of so few hashes reaches this recall")


def gram_sets(words: Words, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-gram hashes of all documents one after another, each once per document, and the number of each document."""
    start, h = words.windows(n)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    doc = words.doc[start]
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k, d in enumerate(short):
            for x in words.hashes[words.first[d] : words.first[d + 1]]:
                whole[k : k + 1] = whole[k : k + 1] * np.uint64(0x9E3779B97F4A7C15) + x
        doc, h = np.concatenate([doc, short]), np.concatenate([h, mix(whole + np.uint64(1))])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return h, np.bincount(doc, minlength=words.n_docs)


def _keys(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two independent 64-bit hashes of each set; 0 for an empty one."""
    some, keys = np.flatnonzero(size), np.zeros((2, len(size)), np.int64)
    if len(some):
        first = (np.cumsum(size) - size)[some]
        keys[0, some] = np.add.reduceat(mix(h), first).view(np.int64)
        keys[1, some] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5DEADBEEF)), first).view(np.int64)
    return keys


def signatures(h: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes, one row for each set that begins at ``first`` in ``h``; sets must not be empty."""
    rng = np.random.default_rng(_SEED)
    a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    out, work = np.zeros((len(first), bands), np.uint64), np.empty_like(h)
    for k in range(bands * rows):
        np.multiply(h, a[k], out=work)
        np.add(work, b[k], out=work)
        out[:, k // rows] = mix(out[:, k // rows] * a[0] + np.minimum.reduceat(work, first))
    return out.view(np.int64)


def sketch_documents(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_grams, key_a, key_b, bands``; keys are two independent 64-bit hashes of the set. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", 1 << 20):
            h, size = gram_sets(Words(*utf8(part.column(1))), n)
            some = np.flatnonzero(size)
            first = (np.cumsum(size) - size)[some]
            keys, sig = _keys(h, size), np.zeros((len(size), bands), np.int64)
            if len(some):
                sig[some] = signatures(h, first, bands, rows)
            at = pa.array(np.arange(0, sig.size + 1, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), pa.ListArray.from_arrays(at, pa.array(sig.ravel()))], ["doc_id", "n_grams", "key_a", "key_b", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_grams long, key_a long, key_b long, bands array<long>")


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component in a graph of n nodes."""
    label = np.arange(n)
    while len(u):
        m = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, m)
        np.minimum.at(label, v, m)
        np.minimum.at(label, before[u], m)
        np.minimum.at(label, before[v], m)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def links_of(grams: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of sets with Jaccard similarity >= threshold; only pairs of different sides if there are two sides.

    Common n-grams are counted by a matrix product over the n-grams that two sets share at least, in strips of bounded size.
    """
    n = len(grams)
    size = np.array([len(g) for g in grams], np.int64)
    owner, h = np.repeat(np.arange(n), size), np.concatenate(grams)
    values, column = np.unique(h, return_inverse=True)
    count = np.bincount(column, minlength=len(values))
    keep = (count > 1)[column]
    owner, column = owner[keep], (np.cumsum(count > 1) - 1)[column[keep]]
    common, width = np.zeros((n, n), np.float32), max(1, 4_000_000 // n)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        strip = np.zeros((n, width), np.float32)
        strip[owner[a:b], column[a:b] - low] = 1
        common += strip @ strip.T
    union = size[:, None] + size[None, :] - common
    hit = np.triu(common >= threshold * union - 1e-6, 1)
    if side.any():
        hit &= side[:, None] != side[None, :]
    return np.nonzero(hit)


def _compare(threshold: float, n: int):
    """Streams rows ``task, side, doc_id, weight, text`` sorted by task; gives counts and forest edges."""

    def flush(ids: list[int], sides: list[int], weights: list[int], grams: list[np.ndarray]) -> list[tuple[int, int, int]]:
        u, v = links_of(grams, np.array(sides), threshold)
        if not len(u):
            return []
        w = np.array(weights, np.int64)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, u, w[v])
        np.add.at(links, v, w[u])
        label = local_components(len(ids), u, v)
        return [(ids[i], ids[label[i]], int(links[i])) for i in np.flatnonzero(links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        task, held, out = None, ([], [], [], []), []

        def batch_of(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "to", "links"])

        for batch in batches:
            tasks, sides, ids, weights = (batch.column(i).to_pylist() for i in range(4))
            for k, raw in enumerate(batch.column(4)):
                if tasks[k] != task:
                    if len(held[0]) > 1:
                        out += flush(*held)
                    task, held = tasks[k], ([], [], [], [])
                    if len(out) > 50_000:
                        yield batch_of(out)
                        out = []
                for x, y in zip(held, (ids[k], sides[k], weights[k], np.frombuffer(raw.as_buffer(), np.uint64).copy()), strict=True):
                    x.append(y)
        if len(held[0]) > 1:
            out += flush(*held)
        if out:
            yield batch_of(out)

    return run


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """``home, size, own, doc_id, weight, grams binary`` of the rows with these, ``key_a`` and ``text`` whose set has that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", 1 << 20):
            h, size = gram_sets(Words(*utf8(part.column(6))), n)
            at = np.concatenate([[0], np.cumsum(size)])
            grams = pa.array([h[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())
            batch = pa.RecordBatch.from_arrays([*part.columns[:5], grams], ["home", "size", "own", "doc_id", "weight", "grams"])
            yield batch.filter(pa.array(_keys(h, size)[0] == np.asarray(part.column(5))))

    return texts.select("home", "size", "own", "doc_id", "weight", "key_a", "text").mapInArrow(run, "home long, size long, own int, doc_id long, weight long, grams binary")


def _cells(candidates: DataFrame, block: int) -> DataFrame:
    """``home, size, blocks, n``: cells of near copies of one home and like size, the blocks they are dealt into, and their members."""
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n_grams") / F.lit(BLOCK_GRAMS))).cast("int")
    return candidates.groupBy("home", "size").agg(blocks.alias("blocks"), F.count("*").alias("n"))


def _cell_pairs(shared: DataFrame, candidates: DataFrame, cells: DataFrame) -> DataFrame:
    """What each cell is compared with: ``home, size, low, high, role, own_blocks, other_blocks``, where low and high are cells.

    Role 0 is the cell with itself, 1 the lower and 2 the higher of two cells of like sizes that have members in one bucket, or
    are of one home. Members of a bucket nearly all share its leader as home, so a bucket has few cells, however many members;
    where it has more than ``LISTED``, no task holds them all.
    """
    cell = F.struct("home", "size")
    sizes = cells.select(cell.alias("cell"), "blocks")
    at = materialize(shared.join(candidates.select("doc_id", cell.alias("cell")), "doc_id").select("band", "h", "cell").distinct(), "bucket-cells")
    several = at.groupBy("band", "h").agg(F.ceil(F.count("*") / F.lit(LISTED)).alias("lists"), F.count("*").alias("n")).where("n > 1").drop("n")
    lists = at.join(several, ["band", "h"]).withColumn("list", F.pmod(F.xxhash64("cell"), F.col("lists")))
    lists = lists.groupBy("band", "h", "list").agg(F.first("lists").alias("lists"), F.array_sort(F.collect_list("cell")).alias("cells"))
    lists = materialize(lists, "cell-lists")
    alike = F.abs(F.col("low.size") - F.col("high.size")) <= 1
    inner = lists.select("cells", F.posexplode("cells").alias("at", "low"))
    inner = inner.select("low", F.explode(F.slice("cells", F.col("at") + 2, F.size("cells"))).alias("high"))
    long = lists.where("lists > 1")
    outer = long.select("band", "h", "list", F.explode("cells").alias("a")).join(long.select("band", "h", F.col("list").alias("other"), F.col("cells").alias("others")), ["band", "h"])
    outer = outer.where("list < other").select("a", F.explode("others").alias("b")).select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    same = sizes.select(F.col("cell").alias("low"), F.struct(F.col("cell.home").alias("home"), (F.col("cell.size") + 1).alias("size")).alias("high"))
    same = same.join(sizes.select(F.col("cell").alias("high")), "high", "left_semi").select("low", "high")
    pairs = inner.unionByName(outer).where(alike).unionByName(same).distinct()
    named = lambda side: sizes.select(F.col("cell").alias(side), F.col("blocks").alias(f"{side}_blocks"))
    pairs = pairs.join(named("low"), "low").join(named("high"), "high")
    rows = lambda own, role, mine, other: F.struct(F.col(f"{own}.home").alias("home"), F.col(f"{own}.size").alias("size"), "low", "high", F.lit(role).alias("role"), F.col(mine).alias("own_blocks"), F.col(other).alias("other_blocks"))
    both = pairs.select(F.explode(F.array(rows("low", 1, "low_blocks", "high_blocks"), rows("high", 2, "high_blocks", "low_blocks"))).alias("r")).select("r.*")
    alone = sizes.select("cell.home", "cell.size", F.col("cell").alias("low"), F.col("cell").alias("high"), F.lit(0).alias("role"), F.col("blocks").alias("own_blocks"), F.col("blocks").alias("other_blocks"))
    return both.unionByName(alone)


def near_duplicates(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per doc_id of ``docs(doc_id, text)``: ``doc_id, class_id, exact_id, n_links, kept``.

    ``exact_id`` is the least doc_id with the same n-gram set, ``class_id`` the least doc_id that links reach, ``n_links`` the
    number of other documents with similarity >= threshold (equal sets included), ``kept`` whether it is its class's least.
    Texts without words (null, empty, blank) link with nothing. Rows that repeat a doc_id are one document, that of the least
    set key; rows with a null doc_id are left out, since nothing could name them. Other columns are ignored, whatever their
    names; an id of another than an integer type is a TypeError. An empty table gives no rows.
    """
    bands, rows = choose_bands(threshold, recall)
    docs = with_long_id(docs.select("doc_id", "text"))
    sketched = materialize(sketch_documents(docs.where("doc_id is not null"), n, bands, rows), "minhash")
    repeats = sketched.groupBy("doc_id").agg(F.count("*").alias("c"), F.min(F.struct("key_a", "key_b")).alias("k")).where("c > 1")
    ids = sketched.select("doc_id", "n_grams", "key_a", "key_b")
    members = ids.join(repeats.select(F.col("doc_id").alias("r"), "k"), F.col("doc_id") == F.col("r"), "left")
    members = members.where("k is null or (key_a = k.key_a and key_b = k.key_b)").select("doc_id", "n_grams", "key_a", "key_b").distinct()
    lone = members.where("n_grams = 0")
    by_set = members.where("n_grams > 0").groupBy("n_grams", "key_a", "key_b").agg(F.min("doc_id").alias("exact_id"), F.count("*").alias("weight"))
    classes = materialize(by_set, "classes")
    reps = classes.select(F.col("exact_id").alias("doc_id"), "weight", "key_a", "n_grams")

    # buckets with more than one representative, each led by its least one; a home is the least leader of a representative
    band_rows = sketched.join(reps, ["doc_id", "key_a", "n_grams"], "left_semi").select("doc_id", F.posexplode("bands").alias("band", "h"))
    least = band_rows.groupBy("band", "h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    least = materialize(least.where("least < most").drop("most"), "leaders")
    shared = materialize(join_by_key(band_rows, least, ["band", "h"], "n"), "buckets")
    done, homes = [least, shared], shared.groupBy("doc_id").agg(F.min("least").alias("home"))
    for _ in range(HOPS):
        lead = materialize(shared.join(homes, "doc_id").groupBy("band", "h").agg(F.min("home").alias("lead"), F.count("*").alias("n")), "leads")
        homes = materialize(join_by_key(shared, lead, ["band", "h"], "n").groupBy("doc_id").agg(F.min("lead").alias("home")), "homes")
        done += [lead, homes]
    # sizes that differ by more than the threshold's share cannot link; a hair wider, for the rounding of logarithms
    size = F.floor(F.log("n_grams") / F.lit(max(1e-9, -math.log(min(1.0, threshold)) * (1 + 1e-9)))).cast("long")
    candidates = materialize(homes.join(reps, "doc_id").withColumn("size", size), "candidates")
    cells = materialize(_cells(candidates, block), "cells")
    # a member's block of its cell, and the plan by cell and block: so a group of near copies is spread over as many keys as blocks
    dealt = join_by_key(candidates, cells, ["home", "size"], "n").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = materialize(dealt.select("doc_id", "home", "size", "own", "weight", "key_a"), "dealt")
    plan = _cell_pairs(shared, candidates, cells).withColumn("own", F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)))
    plan = materialize(plan.drop("own_blocks"), "cell-pairs")

    texts = split_by_ids(docs.select("doc_id", "text"), "doc_id", dealt, "doc_id")[0].join(dealt, "doc_id")
    sets = _sets(texts, n).dropDuplicates(["doc_id"]) if repeats.limit(1).count() else _sets(texts, n)
    placed = sets.join(plan, ["home", "size", "own"])
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    first = F.when(F.col("role") == 0, F.least("own", "other")).when(F.col("role") == 1, F.col("own")).otherwise(F.col("other"))
    second = F.when(F.col("role") == 0, F.greatest("own", "other")).when(F.col("role") == 1, F.col("other")).otherwise(F.col("own"))
    side = F.when(F.col("role") > 0, F.col("role")).when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    tasks = placed.select(F.xxhash64("low", "high", first, second).alias("task"), side.cast("int").alias("side"), "doc_id", "weight", "grams")
    tasks = tasks.repartition("task").sortWithinPartitions("task", "doc_id")
    links = materialize(tasks.mapInArrow(_compare(threshold, n), "doc_id long, to long, links long"), "links")
    for table in (*done, candidates, cells, dealt, plan):
        discard(docs.sparkSession, table)

    found_links = links.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("links"))
    near = connected_components(links.select(F.col("doc_id").alias("u"), F.col("to").alias("v")))
    wide = classes.join(found_links, F.col("exact_id") == F.col("rep"), "left").join(near, F.col("exact_id") == F.col("node"), "left")
    wide = wide.select("n_grams", "key_a", "key_b", "exact_id", F.coalesce("component", "exact_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "weight")
    wide = materialize(wide, "set-classes")
    joined = join_by_key(members.where("n_grams > 0"), wide, ["n_grams", "key_a", "key_b"], "weight").select("doc_id", "class_id", "exact_id", "n_links")
    alone = lone.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("exact_id"), F.lit(0).cast("long").alias("n_links"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without those that a smaller doc_id of their class stands for; rows with a null doc_id stay."""
    gone = materialize(near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("gone_id")), "gone")
    columns = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*columns)
    key = columns[docs.columns.index("doc_id")]
    maybe, stay = split_by_ids(rows, key, gone, "gone_id")
    return maybe.join(gone, F.col(key) == F.col("gone_id"), "left_anti").unionByName(stay).toDF(*docs.columns)
