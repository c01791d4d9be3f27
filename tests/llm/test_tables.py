"""Near-duplicates, components, sharding, archives and the pipeline against plain versions."""

import collections
import gzip
import hashlib
import random
import re
import threading
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from florilege.llm import idfilter, jaccard, neardup, sharding, warc
from florilege.llm import queries as llm_queries
from florilege.llm.components import connected_components
from florilege.llm.storage import discard, fresh_path, materialize, scratch, shared_dir, tidy

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Sets:
    """Union-find over any ids."""

    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# --- storage and components ------------------------------------------------------------------------------------------------
def test_storage(spark):
    rows = materialize(spark.range(5), "t")
    assert rows.count() == 5 and shared_dir(spark) in rows.inputFiles()[0] and fresh_path(spark, "a") != fresh_path(spark, "a")
    discard(spark, rows)
    assert materialize(spark.range(0), "t").count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(None, 2), (2, 3)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(5, 9), (9, 5), (5, 9)], [(random.Random(i).randint(0, 60), random.Random(i + 99).randint(0, 60)) for i in range(45)]])
def test_components(spark, edges):
    rows = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    sets = Sets({x for e in real for x in e})
    for a, b in real:
        sets.join(a, b)
    assert sorted(map(tuple, rows)) == sorted((i, sets.find(i)) for i in sets.up)


@given(st.integers(1, 12), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=25))
@settings(max_examples=200, deadline=None)
def test_local_components(n, edges):
    edges = [(a % n, b % n) for a, b in edges]
    sets = Sets(range(n))
    for a, b in edges:
        sets.join(a, b)
    u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    assert jaccard.local_components(n, u, v).tolist() == [sets.find(i) for i in range(n)]


def test_id_filter_parts_make_the_whole(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(-50, 400)] + [(None, "x")], "k long, t string")
    ids = spark.createDataFrame([(i,) for i in range(0, 400, 7)] + [(None,)], "i long")
    maybe, never = idfilter.split_by_ids(rows, "k", ids, "i")
    a, b = {r.k for r in maybe.collect()}, {r.k for r in never.collect()}
    assert set(range(0, 400, 7)) <= a and not a & b and a | b == {None, *range(-50, 400)} and len(a) < 80


# --- n-gram Jaccard join ------------------------------------------------------------------------------------------------------
def grams(text, n=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else (frozenset([tuple(w)]) if w else frozenset())


def plain_join(rows, threshold=0.8):
    sets = {i: grams(t) for i, t in rows}
    groups, links = Sets(sets), collections.Counter()
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    return {i: (groups.find(i), links[i]) for i in ids}


def near_corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 140))) for _ in range(40)]
    for t in texts[:12]:
        for _ in range(4):  # near copies at all distances around the threshold
            w = t.split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    hot = texts[0].split(" ")
    texts += [" ".join(hot[: k % 7 + 50]) + f" tail{k}" for k in range(60)]  # one large group of different near copies
    texts += [texts[3]] * 20 + ["", "  \n", None, "two words", "two  words", "x " * 5000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [256, 7])
def test_join_against_brute_force(spark, block):
    rows = near_corpus()
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, bands string").repartition(3)
    want = plain_join(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs, block=block).collect()}
    missed = [i for i in want if got[i] != want[i]]
    assert set(got) == set(want) and not missed  # recall is 0.999 a link at the threshold; this seed loses none
    kept = jaccard.drop_near_duplicates(docs, block=block)
    assert {r.doc_id for r in kept.collect()} == {c for c, _ in want.values()} and kept.columns == docs.columns


def test_join_on_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (4, "z " * 3), (4, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2].class_id == 1 and got[2].n_links >= 1 and got[3].n_links == 0 and got[3].kept
    kept = jaccard.drop_near_duplicates(docs).collect()
    assert sum(r.doc_id is None for r in kept) == 1 and 2 not in {r.doc_id for r in kept}
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0 and jaccard.drop_near_duplicates(docs.limit(0)).count() == 0


def test_long_lists_of_cells_and_large_sets(spark, monkeypatch):
    rows = near_corpus(4)
    want = plain_join(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "LISTED", 2)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 300)
    monkeypatch.setattr(jaccard, "HOPS", 0)  # many homes to a bucket
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_sizes_that_are_not_compared_cannot_link(spark, threshold):
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[: 30 + k])) for k in range(120)] + [(500 + k, " ".join(words[:60])) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs, threshold=threshold).collect()}
    assert got == plain_join(rows, threshold)


def test_scratch_removes_what_is_not_kept(spark):
    with scratch(spark):
        a, b = materialize(spark.range(3), "t"), materialize(spark.range(4), "t", keep=True)
        assert a.count() == 3
    assert b.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FILE_NOT_EXIST"):
        materialize(a, "t")
    discard(spark, b)


def folders(spark):
    base = Path(shared_dir(spark).removeprefix("file:")) / "florilege"
    return {p.name for p in base.iterdir()} if base.exists() else set()


@pytest.mark.parametrize("name", sorted(n for n, q in llm_queries.QUERIES.items() if hasattr(q, "__wrapped__")))
def test_a_query_leaves_only_what_its_result_reads(spark, name):
    before = folders(spark)
    rows = llm_queries.QUERIES[name](spark, SF)
    left = folders(spark) - before
    assert left == {f.rsplit("/florilege/", 1)[1].split("/")[0] for f in rows.inputFiles() if "/florilege/" in f}
    assert rows.count() > 0 and len(rows.limit(3).collect()) > 0
    for label in left:
        discard(spark, f"{shared_dir(spark)}/florilege/{label}")


def test_a_query_that_fails_leaves_nothing(spark):
    @tidy
    def fails(spark, sf_dir):
        materialize(spark.range(3), "t")
        raise ValueError("no")

    before = folders(spark)
    with pytest.raises(ValueError, match="no"):
        fails(spark, SF)
    assert folders(spark) == before


def test_threads_keep_their_tables_apart(spark):
    rows = {}

    def other():
        rows["t"] = materialize(spark.range(3), "t")

    with scratch(spark):
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
    assert rows["t"].count() == 3
    discard(spark, rows["t"])


def test_banding_reaches_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = jaccard.choose_bands(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 128
    with pytest.raises(ValueError):
        jaccard.choose_bands(0.1, 0.999, 4)


# --- embeddings ---------------------------------------------------------------------------------------------------------------
def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 16))
    for i in range(60):  # cosines on both sides of the threshold
        x[90 + i] = x[i % 9] + rng.normal(size=16) * rng.choice([0.02, 0.07, 0.09])
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] + [1.0] * 15, 0), (203, [None] + [1.0] * 15, 0), (204, [], 0), (205, [float("inf")] * 16, 0), (206, [1.0, 2.0], 0), (207, [2.0, 4.0], 1), (None, [1.0] * 16, 0), (0, rows[0][1], 5)]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    d = x.astype(float)
    cos = d @ d.T / np.linalg.norm(d, axis=1)[:, None] / np.linalg.norm(d, axis=1)[None, :]
    hit = cos >= 0.95
    np.fill_diagonal(hit, False)
    sets = Sets(range(150))
    for a, b in zip(*np.nonzero(hit), strict=True):
        sets.join(int(a), int(b))
    for tile in (4096, 31):
        got = {r.vec_id: r for r in neardup.near_duplicates(emb, tile=tile).collect()}
        assert set(got) == {*range(150), *range(200, 208)}
        assert all((got[i].n_links, got[i].component_id) == (hit[i].sum(), sets.find(i)) for i in range(150)) and hit.sum() > 50
        assert all(got[i].n_links == 0 and got[i].kept for i in range(200, 206)) and got[207].component_id == 206 and got[206].n_links == 1
    assert neardup.near_duplicates(emb.limit(0)).count() == 0


@given(st.integers(0, 10_000), st.integers(1, 40))
@settings(max_examples=100, deadline=None)
def test_error_bound_holds(seed, dim):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20, dim)) * rng.choice([1, 0.001], size=(1, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, scale, loss = neardup.quantise(x)
    about = neardup.tile_product(q, q).astype(float) * scale[:, None] * scale[None, :]
    assert (np.abs(about - x @ x.T) <= (1 + loss[:, None]) * loss[None, :] + loss[:, None] + 1e-12).all()


@given(st.integers(0, 10_000), st.sampled_from([3, 16, 64]))
@settings(max_examples=60, deadline=None)
def test_int8_values_decide_rightly_or_not_at_all(seed, dim):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(1, dim)) + rng.normal(size=(40, dim)) * rng.choice([0.05, 0.2, 0.4], size=(40, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows, cos = neardup.quantise(x), x @ x.T
    u, v, sure = neardup.decide(rows, rows, 0.95)
    maybe = np.zeros(cos.shape, bool)
    maybe[u, v] = True
    assert (cos[u[sure], v[sure]] >= 0.95).all() and (cos[~maybe] < 0.95).all()
    part = neardup.decide(tuple(m[5:9] for m in rows), tuple(m[20:] for m in rows), 0.95)  # the same in any tile
    assert {(a + 5, b + 20, c) for a, b, c in zip(*(m.tolist() for m in part), strict=True)} == {(a, b, c) for a, b, c in zip(u.tolist(), v.tolist(), sure.tolist(), strict=True) if 5 <= a < 9 and b >= 20}


def test_long_vectors_stay_exact():
    q = np.full((3, 5000), 127, np.int8)
    assert (neardup.tile_product(q, q) == 127 * 127 * 5000).all()


# --- sharding -----------------------------------------------------------------------------------------------------------------
def plain_directory(items, limit):
    """Extendible hashing on (hash bits, bytes): splits only buckets over the limit."""
    open_, out = [("", items)], {}
    while open_:
        prefix, own = open_.pop()
        if sum(n for _, n in own) <= limit or len(own) <= 1:
            out.update({h: prefix for h, _ in own})
            continue
        for bit in "01":
            part = [x for x in own if x[0][len(prefix)] == bit]
            if part:
                open_.append((prefix + bit, part))
    return out


@pytest.mark.parametrize("limit", [100, 1000, 10_000_000])
def test_sharding_against_plain_directory(spark, limit):
    rng = random.Random(0)
    rows = [(i, "é" * rng.randint(0, 60)) for i in range(500)] + [(900, None), (901, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sharding.shard_documents(docs, limit).collect()}
    bits = {i: bin(int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16))[2:].zfill(32) for i, _ in rows}
    want = plain_directory([(bits[i], len((t or "").encode())) for i, t in rows], limit)
    sizes = collections.Counter()
    for i, t in rows:
        sizes[want[bits[i]]] += len((t or "").encode())
    for i, _ in rows:
        shard = want[bits[i]]
        if i != 901:
            assert got[i].shard == shard and got[i].depth == len(shard) and got[i].shard_bytes == sizes[shard] and (sizes[shard] <= limit or got[i].shard_docs == 1)
    assert got[901].shard_docs == 1 or limit > 5000


def test_sharding_odd_rows(spark, tmp_path):
    rows = [(7, "x" * 50)] * 40 + [(None, "y" * 50)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(docs, 200).collect()
    assert len(got) == 45 and all(r.shard_bytes <= 200 for r in got)  # repeated ids are told apart by their place
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    rows = [(i, "z" * 30, 1) for i in range(60)] + [(7, "x" * 50, 2)] * 40 + [(None, "y" * 50, 3)] * 5 + [(1, None, 4), (1, "", 5)]
    few = spark.createDataFrame(rows, "doc_id long, text string, Shard int").repartition(3)
    for most in (1 << 16, 0):  # a directory that is broadcast, and one that is joined
        path = str(tmp_path / f"s{most}")
        assert sharding.write_shards(few, path, 300, most) == "shard_"
        back = spark.read.option("basePath", path).schema("doc_id long, text string, Shard int, shard_ string").parquet(path).collect()
        assert collections.Counter(r[:3] for r in back) == collections.Counter(rows)
        sizes = collections.Counter()
        for r in back:
            sizes[r[3]] += len((r.text or "").encode())
        assert max(sizes.values()) <= 300 and len(list((tmp_path / f"s{most}").rglob("*.parquet"))) == len(sizes)
    sharding.write_shards(few.limit(0), str(tmp_path / "none"))


def test_sharding_beyond_the_first_count(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([None, 3, 4, i]), "x" * rng.randint(0, 90)) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(sharding, "MORE_BITS", 3)
    for most in (1 << 16, 0):
        got = sharding.shard_documents(docs, 400, most).collect()
        sizes, docs_of = collections.Counter(), collections.Counter(r.shard for r in got)
        for r in got:
            sizes[r.shard] += r.n_bytes
        assert sorted((r.doc_id or -1, r.n_bytes) for r in got) == sorted((i or -1, len(t)) for i, t in rows)
        assert all(r.depth == len(r.shard) and r.shard_bytes == sizes[r.shard] and r.shard_docs == docs_of[r.shard] for r in got)
        assert all(sizes[s] <= 400 or docs_of[s] == 1 for s in sizes) and max(map(len, sizes)) > 32
        # no shard could be joined with what lies beside it: each parent is over the limit
        assert all(sum(n for t, n in sizes.items() if t.startswith(s[:-1])) > 400 for s in sizes)


# --- archives -----------------------------------------------------------------------------------------------------------------
def test_archive_round_trip(spark):
    big, small = "<html>é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</html>" + "x" * 200, "tiny"
    rows = [(5, "http://a/b?q#f", big), (3, "http://a/c", big), (9, None, big), (1, "bad url\r\nWARC-Type: x", small), (2, "u", small), (4, "u", None), (6, "u", ""), (7, "u", "\r\n\r\n" + "y" * 300), (None, "u", "z" * 150), (8, "u", "p" * 99), (10, "u", "p" * 99)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, fields int").repartition(3)
    path = fresh_path(spark, "warc")
    warc.write_archives(warc.with_revisits(pages), path)
    records = warc.read_archives(spark, path)
    assert records.count() == 3 * len(rows)
    got = {r.page_id: r for r in warc.assemble(records).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        raw, r = (html or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        first = min(j for j, _, h in rows if h == html and j is not None) if i is not None else i
        revisit = len(raw) >= 100 and i != first
        assert (r.warc_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
        assert r.request is not None and len(r.metadata) == 1 and f"payloadBytes: {len(raw)}" in r.metadata[0].fields
        assert revisit or bytes(r.response.payload) == raw
    assert got[5].request.fields.startswith("GET /b?q HTTP/1.1\r\nHost: a") and got[9].request is not None
    empty = fresh_path(spark, "warc")
    warc.write_archives(warc.with_revisits(pages.limit(0)), empty)
    assert warc.assemble(warc.read_archives(spark, empty)).count() == 0


def test_reader_takes_members_and_any_parts():
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    both = gzip.compress(one) + gzip.compress(one)
    assert [(b, e) for _, b, e in warc.parse(warc.inflate(both))] == [(b"ab\r\n", None)] * 2
    for n in (1, 3, 1000):
        parts = (one[i : i + n] for i in range(0, len(one), n))
        assert [(f["warc-type"], b, e) for f, b, e in warc.parse(parts)] == [(["metadata"], b"ab\r\n", None)]


def test_reader_makes_rows_of_what_it_cannot_read(spark, tmp_path):
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nWARC-Concurrent-To: <x>\r\nwarc-concurrent-to:\r\n <y>\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    bad = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <b>\r\nContent-Length: 4x\r\n\r\nab\r\nWARC/ in it\r\n\r\n"
    none = b"WARC/1.1\r\nWARC-Type: request\r\n\r\n\r\n\r\n"
    page = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: seven\r\nContent-Length: 1\r\n\r\nz\r\n\r\n"
    whole = one + bad + none + one + page + one[:-9]
    for n in (1, 7, 10_000):
        got = list(warc.parse(whole[i : i + n] for i in range(0, len(whole), n)))
        assert [e is None for _, _, e in got] == [True, False, False, True, True, False]
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.warc").write_bytes(whole)
    (folder / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one * 50)[:60])
    rows = warc.read_archives(spark, str(folder)).collect()
    assert sum(r.error is None for r in rows) == 3 and sum(r.error is not None for r in rows) == 5
    assert all(r.concurrent_to == ["<x>", "<y>"] for r in rows if r.error is None)
    assert warc.assemble(warc.read_archives(spark, str(folder))).count() == 0


def test_files_are_filled_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    pages = spark.createDataFrame([(i, "u", f"{i:04d}" * (1500 if i % 7 == 0 else 100)) for i in range(60)] + [(60, "u", "z" * 90_000)], "page_id long, url string, html string").repartition(2)
    path = fresh_path(spark, "warc")
    warc.write_archives(warc.with_revisits(pages), path)
    files = [f.content for f in spark.read.format("binaryFile").load(path).select("content").collect()]
    sizes = sorted(len(gzip.decompress(f)) for f in files)
    assert sizes[-1] > 90_000 and sizes[-2] <= 20_004 and len(sizes) < 14 and warc.read_archives(spark, path).count() == 183


@pytest.mark.parametrize("most", [100_000, 0])
def test_revisits_against_plain_groups(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    monkeypatch.setattr(idfilter, "LEAST_WORDS", 1)
    monkeypatch.setattr(idfilter, "MOST_WORDS", 1)  # a bitmap that nearly everything matches
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(300)]), str(i), rng.choice(["x" * 99, None, *(f"{k}" * 120 for k in range(100, 160)), f"{i:05d}" * 40])) for i in range(400)] + [(None, "a", "n" * 200), (None, "b", "n" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.url: r for r in warc.with_revisits(pages).collect()}
    first = {}
    for i, _, html in rows:
        if html and len(html) >= 100 and i is not None:
            first[html] = min(first.get(html, i), i)
    assert len(got) == len(rows)
    for i, url, html in rows:
        of = first.get(html)
        assert got[url].refers_to == (of if of is not None and of != i else None)
        assert got[url].html == (None if got[url].refers_to is not None else html or "")


def test_transactions_are_joined_by_concurrent_to(spark):
    schema = warc.RECORDS
    names = [x.split(" ")[0] for x in schema.split(", ")]
    make = lambda **k: tuple(k.get(n) for n in names)
    rows = [
        make(warc_type="response", record_id="r1", page_id=1), make(warc_type="metadata", record_id="m2", concurrent_to=["r1"]), make(warc_type="metadata", record_id="m1", concurrent_to=["gone", "r1"]),
        make(warc_type="request", record_id="q9", concurrent_to=["gone"]), make(warc_type="response", record_id="r2", page_id=2), make(warc_type="warcinfo", record_id="w"), make(warc_type="request", record_id="q0"),
        make(warc_type="response", record_id="r3", page_id=3, concurrent_to=["q3", "m3"]), make(warc_type="request", record_id="q3"), make(warc_type="metadata", record_id="m3"),  # the response names them
        make(warc_type="metadata", record_id="m4", concurrent_to=["q3"]),  # names the request
        make(warc_type="metadata", record_id="m5", concurrent_to=["q3", "r2"]),  # names another response too, which it belongs to
        make(warc_type="response", record_id=None, page_id=4), make(warc_type="response", record_id="r5", page_id=5, error="broken"),
    ]
    got = {r.page_id: (r.request and r.request.record_id, [m.record_id for m in r.metadata]) for r in warc.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (None, ["m1", "m2"]), 2: (None, ["m5"]), 3: ("q3", ["m3", "m4"]), 4: (None, [])}


# --- pipeline -----------------------------------------------------------------------------------------------------------------
def test_pipeline_stages_and_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from florilege.llm import pii, quality, rules

    words = [w for _, t in near_corpus() if t for w in t.split(" ")][:500]
    rng = random.Random(1)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(40, 90))) for _ in range(150)]
    texts += [texts[0], texts[1] + " more", texts[2] + " me@example.org"] + [" ".join(w + "###" for w in t.split(" ")) for t in texts[:40]] + ["", None]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 153), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "personal_data", "packing"]
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, materialize(stage(spark, now, str(tmp_path)), name)
        if name != "packing":
            assert now.columns == docs.columns
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
        if name == "quality_rules":
            assert kept[-1] == {r.doc_id for r in rules.judge_documents(before).collect() if r.kept}
        if name == "quality_classifier":
            corpus = quality.classify_documents(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
            assert kept[-1] == kept[-2] & {r.doc_id for r in corpus.collect() if r.predicted}
        if name == "near_duplicates":
            want = plain_join([(r.doc_id, r.text) for r in before.collect()])
            assert kept[-1] == {c for c, _ in want.values()}
        if name == "personal_data":
            model = pii.trained()
            texts_before = {r.doc_id: r.text for r in before.collect()}
            assert all(r.text == pii.redact(texts_before[r.doc_id], pii.find_spans(texts_before[r.doc_id], model)[1]) and r.n_chars == len(r.text) for r in now.collect())
    assert kept[-1] == kept[-2] and 0 in kept[-1] and 150 not in kept[-1]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(whole) == key(now)


def test_pipeline_on_odd_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, rule string"
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(60))
    rows = [(1, text, "en", None, 3, "x"), (1, text, "en", None, 3, "x"), (None, text, None, "s", 1, "y"), (2, None, "en", "s", None, None), (3, "", None, None, 0, "z"), (4, text + " tail", "en", "s", 9, "q")]
    for name, table in (("odd", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(table, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        got = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, d).collect())
        assert got == ({1: 2, None: 1} if table else {})
        now = spark.read.parquet(f"{d}/documents.parquet")
        for stage in (f for n, f in corpus_pipeline.STAGES if n != "packing"):
            now = stage(spark, now, d)
            assert now.columns == [c.split(" ")[0] for c in schema.split(", ")]


def test_library_does_not_need_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2] / "florilege"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "florilege.llm" not in path.read_text()


def test_reading_of_entry():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert F is not None
