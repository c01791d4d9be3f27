from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from florilege.functions import kernels, text
from florilege.schema import ChunkOptions, checked_top_k
import pytest


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def words(n):
    return " ".join(f"w{i}" for i in range(n))


@pytest.mark.parametrize(("n", "size", "overlap", "expected"), [
    (0, 220, 40, []), (50, 220, 40, [(0, 189)]), (100, 30, 10, [(0, 109), (70, 189), (150, 269), (230, 349), (310, 389)]), (205, 100, 20, [(0, 389), (310, 789), (690, 914)]),
    (300, 220, 40, [(0, 989), (790, 1389)]), (10, 4, 9, [(0, 11), (9, 20), (18, 29)]), (10, 0, 3, [(0, 29)]), (10, 4, -2, [(0, 11), (18, 29)]),
])
def test_windows_by_options(n, size, overlap, expected):
    assert [(a, b) for a, b, _ in kernels.windows(words(n), *ChunkOptions(size, overlap).normalised())] == expected


@given(st.text(alphabet=" \n\t\r\x0b abé中 ", max_size=120), st.integers(1, 6), st.integers(-2, 5))
@settings(max_examples=200, deadline=None)
def test_windows_properties(t, size, overlap):
    size, step = ChunkOptions(size, overlap).normalised()
    raw, found = t.encode(), kernels.windows(t, size, step)
    for a, b, part in found:
        assert raw[a:b].decode().strip(kernels.WHITE_SPACE) == part != ""
    if overlap >= 0 and found and all(c not in t for c in "  \x0b"):
        assert raw[: found[0][0]].strip(b" \n\t\r") == b"" and raw[found[-1][1] :].strip(b" \n\t\r") == b""


def test_fnv_golden(spark):
    golden = {"": 2166136261, "a": 3826002220, "foo": 2851307223, "foo_bar": 32505821, "revenue": 3478921115}
    assert kernels.fnv1a([k.encode() for k in golden]).tolist() == list(golden.values())
    rows = spark.createDataFrame([(k,) for k in golden], ["k"]).select("k", text.fnv1a(F.col("k")).alias("h")).collect()
    assert {r.k: r.h for r in rows} == golden


@pytest.mark.parametrize("t", ["", "Hello, World_1 é-ab", "İstanbul K9 ẞx", "a  b\nc", "ÀB"])
def test_tokens_agree_between_jvm_and_kernel(spark, t):
    assert one(spark, text.tokens(F.col("t")), t=t) == [x.decode() for x in kernels.tokens(t)]


def test_lowering_of_dotted_i():
    assert kernels.tokens("İx") == [b"ix"]


def test_features(spark):
    assert one(spark, text.features(F.array(F.lit("a"), F.lit("b"), F.lit("a")))) == ["a", "b", "a", "a_b", "b_a"]
    assert one(spark, text.features(F.expr("cast(array() as array<string>)"))) == []


def test_markdown_blanking(spark):
    cases = {
        "# Title Heading": "  Title Heading", "```go\nx\n```": "   go\nx\n   ", "foo_bar **b**": "foo bar   b  ", "[link](http://x.y) z": " link" + " " * 13 + " z",
        "![i](u)": "  i    ", "a\x00b": "a b", "####### x": "####### x", "é# x\n## y": "é# x\n   y", "": "",
    }
    for raw, wanted in cases.items():
        got = one(spark, text.blank_markdown(F.col("t")), t=raw)
        assert one(spark, F.octet_length(text.blank_markdown(F.col("t"))) == F.octet_length(F.concat(text.blank_markdown(F.col("t")))), t=raw)  # used twice
        assert got == wanted and len(got.encode()) == len(raw.encode())


def test_snippet_cuts_bytes(spark):
    assert one(spark, text.snippet(F.col("t"), 3), t="abcd") == "abc…"
    assert one(spark, text.snippet(F.col("t"), 3), t="abc") == "abc"
    assert one(spark, text.snippet(F.col("t"), 2), t="aé!") == "a�…"


def test_extension_and_mime(spark):
    for path, ext, mime in [("a/b.md", ".md", "text/markdown"), (".md", ".md", "text/markdown"), ("a.", ".", text.CODE_MIME), ("d.x/n", "", text.CODE_MIME), ("X.PNG", ".PNG", text.CODE_MIME), ("x.png", ".png", "image/png")]:
        assert one(spark, text.extension(F.col("p")), p=path) == ext
        assert one(spark, text.mime_type(F.col("p")), p=path) == mime


def test_page_number(spark):
    bounds = F.array(F.lit(10), F.lit(20))
    assert [one(spark, text.page_number(bounds, F.lit(x))) for x in (0, 9, 10, 25)] == [1, 1, 2, 3]
    assert one(spark, text.page_number(F.expr("cast(array() as array<int>)"), F.lit(5))) is None


def test_unicode_trim(spark):
    assert one(spark, text.unicode_trim(F.col("t")), t="   a b　\n") == "a b"


def test_ids(spark):
    assert one(spark, text.short_id(F.lit("policies"))) == "5b3a02e57af9b55a"
    assert one(spark, text.short_id(F.lit("a/doc.txt"))) == "f9baf847b53c9a06"
    assert one(spark, text.chunk_id(F.lit("d1"), F.lit(0))) == "b981c0d11db5cf58"


def test_top_k():
    assert checked_top_k(0) == 5 and checked_top_k(3) == 3
    with pytest.raises(ValueError):
        checked_top_k(-1)
