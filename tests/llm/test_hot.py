"""Joins by hot keys, and groups of near copies that are spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from florilege.llm import hot, jaccard
from florilege.llm.components import connected_components
from florilege.llm.hot import join_by_key
from florilege.llm.jaccard import near_duplicates


@pytest.mark.parametrize(("rows_hot", "most"), [(20_000, 10), (50, 10), (2, 1), (0, 10_000)])
def test_join_by_key_is_a_join(spark, monkeypatch, rows_hot, most):
    monkeypatch.setattr(hot, "HOT_ROWS", max(rows_hot, 1))
    monkeypatch.setattr(hot, "MOST_HOT", most)
    rows = spark.range(900).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40)).alias("a"), F.lit(1).alias("b"), "id").unionByName(spark.range(5).select(F.lit(None).cast("long").alias("a"), F.lit(1).alias("b"), "id"))
    table = rows.where("a is not null").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("a < 35").cache()
    got = join_by_key(rows, table, ["a", "b"], "n")
    want = rows.join(table.drop("n"), ["a", "b"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select("a", "b", "id", "least").collect())) == sorted(map(tuple, want.select("a", "b", "id", "least").collect()))


def test_components_with_a_hot_centre(spark, monkeypatch):
    monkeypatch.setattr(hot, "HOT_ROWS", 10)
    edges = [(k, 0) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(40)] + [(299, 1000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got.values()) == {0} and len(got) == 300 + 41


def test_a_large_group_of_near_copies_is_dealt_out(spark, monkeypatch):
    """Links are those of brute force, and no key of the join that sends sets to their tasks has more sets than a block, or so."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    base = rng.choices(words, k=120)
    texts = [" ".join([*base, f"x{k % 150}"]) for k in range(300)] + [" ".join(rng.choices(words, k=60)) for _ in range(60)] + ["same words in all of these copies here"] * 80
    monkeypatch.setattr(hot, "HOT_ROWS", 25)
    seen = {}
    real = jaccard.materialize

    def noted(rows, label):
        out = real(rows, label)
        if label == "dealt":
            seen["largest"] = out.groupBy("home", "size", "own").count().agg(F.max("count")).first()[0]
            seen["cells"] = out.groupBy("home", "size").count().agg(F.max("count")).first()[0]
        return out

    monkeypatch.setattr(jaccard, "materialize", noted)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: (r.n_links, r.class_id) for r in near_duplicates(docs, block=16).collect()}
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    links = {i: [j for j in range(len(texts)) if j != i and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])] for i in range(len(texts))}
    assert {i: n for i, (n, _) in got.items()} == {i: len(x) for i, x in links.items()}
    assert all(got[i][1] == min([i, *links[i]]) for i in links)  # groups here are cliques
    assert seen["cells"] == 150 and seen["largest"] <= 3 * 16


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "text of it")], "doc_id string, text string")
    with pytest.raises(TypeError, match="doc_id must be of an integer type, not string"):
        near_duplicates(docs)
