"""Embedding near-duplicates: Int8 quantised tile products with rigorous error bounds.

Vectors are scaled to length 1 and quantised to Int8 with a scale each; the length of what quantising lost is kept too. They
are dealt by hash into blocks, and each pair of blocks is a task of bounded size. For unit vectors x, y with quantised x', y'
and losses a = |x - x'|, b = |y - y'|:   |x.y - x'.y'| <= |x'| b + a |y| <= (1 + a) b + a.
A tile product over the Int8 values (exact integers) thus shows most pairs to be below or above the threshold. Only Int8 values
go to the tiles. A task names the vectors of the pairs that the bound leaves open; these alone are sent to it again, with their
double precision components, and only the open pairs are computed anew. Tasks return link counts and a spanning forest, never
the pairs.

Every pair of vectors is compared once, in tiles: the work is quadratic by the method's nature, and each task is of equal size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.components import connected_components
from florilege.llm.jaccard import local_components
from florilege.llm.storage import materialize

THRESHOLD = 0.95
#: Bytes of Int8 values of a block at most, and the tasks for each core that smaller inputs are still cut into.
TILE_BYTES, TASKS_PER_CORE = 2 << 20, 3
#: Pairs whose products are held at a time.
_STRIP = 1 << 21
#: Rounding of the float32 scaling of a tile, far above its true size.
_SLACK = 1e-5
#: Integer products of so many Int8 pairs are exact in float32.
_EXACT = 1024
_LINKS = "dim int, low int, high int, side int, vec_id long, to long, links long"
#: Repeated ids up to which their names are broadcast.
_BROADCAST_IDS = 100_000


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values, scales and the lengths of the losses of unit rows."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1) * (1 + 1e-12)


def prepare(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, q, scale, loss, x`` of the vectors that can link: not null, not zero, all components finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                values = part.column(1)
                size = np.asarray(values.value_lengths().fill_null(0))
                for dim in np.unique(size[size > 0]):
                    rows = np.flatnonzero(size == dim)
                    x = values.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
                    with np.errstate(all="ignore"):
                        top = np.abs(x).max(1)
                        ok = np.isfinite(x).all(1) & (top > 0)
                        x, kept = x[ok] / top[ok, None], rows[ok]
                    x /= np.linalg.norm(x, axis=1)[:, None]
                    if not len(kept):
                        continue
                    q, scale, loss = quantise(x)
                    binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[kept], pa.int64()), pa.array(np.full(len(kept), dim), pa.int32()), binary(q), pa.array(scale), pa.array(loss), binary(x)], ["vec_id", "dim", "q", "scale", "loss", "x"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, q binary, scale double, loss double, x binary")


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of Int8 rows."""
    if a.shape[1] <= _EXACT:
        return a.astype(np.float32, copy=False) @ b.astype(np.float32, copy=False).T
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], _EXACT):
        out += a[:, k : k + _EXACT].astype(np.float32, copy=False) @ b[:, k : k + _EXACT].astype(np.float32, copy=False).T
    return out


def decide(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a and b, each (q, scale, loss), whose cosine may reach the threshold, and whether it surely does.

    The products are exact, so a pair is judged alike whatever else is in the tile.
    """
    near = tile_product(a[0], b[0])
    near *= a[1][:, None].astype(near.dtype)
    near *= b[1][None, :].astype(near.dtype)
    widest = (1 + a[2].max()) * b[2].max() + a[2].max() + _SLACK
    u, v = np.nonzero(near >= threshold - widest)
    bound = (1 + a[2][u]) * b[2][v] + a[2][u] + _SLACK
    about = near[u, v].astype(float)
    some = about + bound >= threshold
    return u[some], v[some], (about - bound >= threshold)[some]


def _tiles(threshold: float, exact: bool):
    """Compares the two blocks of a task: first by Int8 values, then, with ``exact``, what they left open.

    Rows of links have ``links``; first, rows without name the vectors of open pairs.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim, low, high = (k.as_py() for k in key)
        side, ids = np.asarray(table["side"]), np.asarray(table["vec_id"])
        matrix = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind).reshape(-1, dim)
        all_ = (matrix("q", np.int8).astype(np.float32), np.asarray(table["scale"]), np.asarray(table["loss"]))
        x = matrix("x", np.float64) if exact else None
        alone = low == high
        left, right = (np.arange(len(ids)) if alone else np.flatnonzero(side == k) for k in (1, 2))
        links, label, open_ = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.zeros(len(ids), bool)
        b = tuple(m[right] for m in all_)
        strip = max(1, _STRIP // max(1, len(right)))
        for at in range(0, len(left) if len(right) else 0, strip):
            rows = left[at : at + strip]
            u, v, sure = decide(tuple(m[rows] for m in all_), b, threshold)
            u, v = rows[u], right[v]
            if alone:
                u, v, sure = u[u < v], v[u < v], sure[u < v]
            if exact:
                u, v = u[~sure], v[~sure]
                hit = np.zeros(len(u), bool)
                for part in np.array_split(np.arange(len(u)), max(1, len(u) * dim // (1 << 22))):
                    hit[part] = np.einsum("ij,ij->i", x[u[part]], x[v[part]]) >= threshold
                u, v = u[hit], v[hit]
            else:
                open_[u[~sure]] = open_[v[~sure]] = True
                u, v = u[sure], v[sure]
            if len(u):
                links += np.bincount(u, minlength=len(ids)) + np.bincount(v, minlength=len(ids))
                pairs = np.unique(label[u] * len(ids) + label[v])
                label = local_components(len(ids), pairs // len(ids), pairs % len(ids))[label]
        some, more = np.flatnonzero(links), np.flatnonzero(open_)
        n = len(some) + len(more)
        name = lambda value: pa.array(np.full(n, value, np.int32))
        rows = np.concatenate([some, more])
        counts = pa.array(np.concatenate([links[some], np.zeros(len(more), np.int64)]), mask=np.arange(n) >= len(some))
        return pa.table([name(dim), name(low), name(high), pa.array(side[rows], pa.int32()), pa.array(ids[rows]), pa.array(ids[label[rows]]), counts], names=[x.split(" ")[0] for x in _LINKS.split(", ")])

    return run


def _unique(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ids, each once, and one vector of each: of ids that repeat the least. Vectors of other ids are not moved."""
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    ids = materialize(rows.groupBy("vec_id").agg(F.count("*").alias("n")), "vector-ids")
    repeated = ids.where("n > 1").select("vec_id")
    n = repeated.count()
    if n:
        repeated = F.broadcast(repeated) if n <= _BROADCAST_IDS else repeated
        least = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        rows = rows.join(repeated, "vec_id", "left_anti").unionByName(least)
    return ids.select("vec_id"), rows


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int | None = None) -> DataFrame:
    """One row per vec_id of ``vectors(vec_id, embedding)``: ``vec_id, n_links, component_id, kept``.

    Two vectors link if their cosine in double precision is at least ``threshold``. Vectors that are null, zero or hold null or
    non-finite components, and vectors of different lengths, link with nothing. Rows that repeat a vec_id are one vector, the
    least; rows with a null vec_id are left out, since nothing could name them. Other columns are ignored; an empty table
    gives no rows. ``tile`` is the number of vectors of a block; by default as many as ``TILE_BYTES`` holds, or fewer, so that
    there are some tasks for every core.
    """
    ids, rows = _unique(vectors)
    ready = materialize(prepare(rows), "vectors")
    n, dim = ready.agg(F.count("*"), F.max("dim")).first()
    tasks = TASKS_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism
    blocks = -(-n // tile) if tile else max(-(-n * (dim or 1) // TILE_BYTES), min(-(-n // 64), math.ceil(math.sqrt(2 * tasks))))
    blocks = max(1, blocks)
    lean = ready.select("vec_id", "dim", "q", "scale", "loss").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    placed = lean.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    side = F.when(F.col("own") == F.col("other"), 0).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(2))
    tiles = placed.select("dim", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side.alias("side"), "vec_id", "q", "scale", "loss")
    first = materialize(tiles.groupBy("dim", "low", "high").applyInArrow(_tiles(threshold, False), _LINKS), "links")
    asked = first.where("links is null").select("low", "high", "side", F.col("vec_id").alias("asked_id"))
    full = ready.join(asked, F.col("vec_id") == F.col("asked_id")).drop("asked_id")
    second = materialize(full.groupBy("dim", "low", "high").applyInArrow(_tiles(threshold, True), _LINKS), "open-links")
    links = first.where("links is not null").unionByName(second).select("vec_id", "to", "links")
    counts = links.groupBy(F.col("vec_id").alias("linked_id")).agg(F.sum("links").alias("links"))
    groups = connected_components(links.select(F.col("vec_id").alias("u"), F.col("to").alias("v")))
    out = ids.join(counts, F.col("vec_id") == F.col("linked_id"), "left").join(groups, F.col("vec_id") == F.col("node"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
