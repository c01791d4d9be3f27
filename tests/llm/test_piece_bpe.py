"""SentencePiece encoding against the library, and its digests over small tables."""

import hashlib
import random

import pytest

from florilege.llm import piece_bpe
from florilege.llm.piece_bpe import Encoder, Vocabulary, digest_documents, encode_documents, decode_documents, merge

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "Hello world", "  two  blanks ", "ends ", "a\nb\r\n\tc", "2023-11-05 (12,345.67)", "Füße über Straßen", "中文 and 😀", "re-́combined ▁ literal", "\u0000nul", "the" * 50_000, " " * 5_000, "x" * 20_000]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(MODEL)


def test_texts_and_random_ones_equal_the_library(library, encoder):
    rng = random.Random(11)
    alphabet = "ab ethingrs▁  \n\t0123.,;'éßüñд中文😀\u0000�́A"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(5_000)]
    for text in texts:
        ids = encoder.encode(text)
        assert ids == library.encode(text, add_eos=True), text[:50]
        assert encoder.decode(ids) == library.decode(ids), text[:50]


def test_random_ids_decode_as_the_library_says(library, encoder):
    rng = random.Random(12)
    blank = encoder.vocabulary.ids["▁"]
    for _ in range(5_000):
        ids = [rng.choice([0, 1, 2, blank, 259, rng.randrange(3, 259), rng.randrange(259, 32_000)]) for _ in range(rng.randrange(8))]
        assert encoder.decode(ids) == library.decode(ids), ids


def test_cuts_change_nothing(encoder):
    """The agenda over a whole text and over its stretches gives the same symbols."""
    v = encoder.vocabulary
    for text in (t for t in TEXTS if 0 < len(t) < 25_000):
        whole = "▁" + text.replace(" ", "▁")
        assert "".join(encoder.cuts(whole)) == whole
        assert merge(whole, v) == [s for part in encoder.cuts(whole) for s in merge(part, v)]


def test_equal_scores_go_from_left_to_right(encoder, library):
    assert merge("▁" * 17, encoder.vocabulary) == ["▁" * 16, "▁"]
    for n in range(1, 70):
        assert ["▁" * len(p) for p in library.encode_as_pieces(" " * n)] == merge("▁" * (n + 1), encoder.vocabulary)


def test_kept_stretches_are_bounded(monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHED_BYTES", 2_000)
    small = Encoder(MODEL)
    first = small.encode("some words that are different each " * 3)
    assert small.known._bytes <= 2_000 and small.encode("some words that are different each " * 3) == first


def test_a_wrong_stretch_is_noticed_wherever_it_occurs(monkeypatch):
    checked = piece_bpe.Checked(MODEL)
    assert [same for *_, same in checked.digest(TEXTS)] == [True] * len(TEXTS)
    checked = piece_bpe.Checked(MODEL)
    monkeypatch.setattr(piece_bpe, "merge", lambda text, v: list(text) if text == "▁two" else merge(text, v))
    assert [same for *_, same in checked.digest(["one", "one two", "two"])] == [True, False, False]
    assert [same for *_, same in checked.digest(["three", "one two three"])] == [True, False]


def test_other_models_are_named(tmp_path):
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = proto.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    (tmp_path / "unigram.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="no merge-type"):
        Vocabulary(str(tmp_path / "unigram.model"))


def test_without_byte_pieces_unknown_characters_share_an_id(tmp_path):
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    spm = pytest.importorskip("sentencepiece")
    model = proto.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.byte_fallback = False
    for piece in model.pieces:
        if piece.type == 6:
            piece.type = 3
    path = str(tmp_path / "plain.model")
    (tmp_path / "plain.model").write_bytes(model.SerializeToString())
    own, theirs = Encoder(path), spm.SentencePieceProcessor(model_file=path)
    for text in ("a😀😀b", "😀", "x \n\n y", "no unknown ones"):
        assert own.encode(text) == theirs.encode(text, add_eos=True), text


def test_query_over_nulls_repeats_and_other_columns(spark, library):
    rows = [(k, t, "de", "x") for k, t in enumerate(TEXTS)] + [(2, TEXTS[2], "de", "y"), (99, None, None, None), (None, "no id", "en", "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string, agrees string")
    got = digest_documents(docs, MODEL).collect()
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    back = decode_documents(encode_documents(docs, MODEL), MODEL)
    assert {r.doc_id: r.text for r in back.where("doc_id < 9").collect()} == {k: t for k, t in enumerate(TEXTS) if k < 9}
    assert digest_documents(docs.limit(0), MODEL).count() == 0
    with pytest.raises(TypeError, match="doc_id must be of an integer type"):
        digest_documents(docs.withColumn("doc_id", docs.doc_id.cast("string")), MODEL)
