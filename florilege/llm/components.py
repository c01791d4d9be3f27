"""Connected components of a graph given by edge rows, by alternating large-star and small-star steps.

A step is one aggregation by node and one join with its result; rounds are logarithmic in the graph's size in practice. Edges
shrink towards stars around the least node of each component, which may have a third of all edges: such nodes are joined apart.
Each step of many edges, and each round, is written to the shared folder, so lineage stays short and nothing but counts and a
fingerprint reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm import hot
from florilege.llm.hot import join_by_key
from florilege.llm.storage import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """``u, m, n``: each first end with the least of its second ends and its number of edges."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("u", "m"))
    linked = lambda rows: rows.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    if few:
        return linked(both.where("v > u").join(least, "u"))
    least = materialize(least, "least")
    out = materialize(linked(join_by_key(both.where("v > u"), least, ["u"], "n")), "edges")
    discard(edges.sparkSession, least)
    return out


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = _least(edges)
    linked = lambda rows, least: rows.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    if few:
        return materialize(linked(edges.join(least, "u"), least), "edges")
    least = materialize(least, "least")
    out = materialize(linked(join_by_key(edges, least, ["u"], "n"), least), "edges")
    for table in (least, edges):
        discard(edges.sparkSession, table)
    return out


def _fingerprint(edges: DataFrame) -> tuple[int, int, int]:
    """Number of edges and two hashes of their set; they are distinct, so equal prints mean equal sets but for collisions."""
    n = F.count("*").alias("n")
    return tuple(edges.agg(n, F.expr("bit_xor(xxhash64(u, v))").alias("a"), F.expr("bit_xor(xxhash64(v, u, 7))").alias("b")).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node with an edge in ``edges(u, v)``; component is its least reachable node.

    Direction, repeats and loops don't matter; rows with a null end are ignored. An empty table gives no rows.
    """
    spark = edges.sparkSession
    now = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    seen = _fingerprint(now)
    for _ in range(max_rounds):
        few = 2 * seen[0] <= hot.HOT_ROWS  # so few edges that no node can be hot
        nxt = _small_star(_large_star(now, few), few)
        discard(spark, now)
        now, before, seen = nxt, seen, _fingerprint(nxt)
        if seen == before:  # a round that changes nothing: all stars
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
