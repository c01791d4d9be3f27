"""SentencePiece encoding and decoding with merge-type vocabularies: a score-ordered agenda of adjacent symbol pairs.

A text is normalised as the model says (blanks become U+2581, one of which is put before the text) and starts as one symbol per
character. The agenda holds every adjacent pair whose joined string is a piece, by the piece's score and then from left to
right; the best pair is joined, and its new neighbours enter the agenda. An entry whose symbols have changed meanwhile is left
out when its turn comes. Characters that are no piece in the end become their bytes.

Where no piece has a U+2581 after another character, and no piece has characters of two groups (letters and marks, say), no merge
reaches across such a place; :class:`Encoder` reads both off the vocabulary, cuts texts there, and keeps the ids of the stretches
between in a table of bounded bytes. A stretch of n characters takes O(n log n), whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from florilege.llm.ids import with_long_id
from florilege.llm.textkernels import sliced
from florilege.llm.worker import begin, keeps

#: Bytes that kept stretches and their ids may take in a worker, about; the longest of them in characters; bytes of texts at a time.
CACHED_BYTES, CACHED_CHARS, SLICE_BYTES = 256 << 20, 40, 2 << 20
BLANK = "▁"
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6


class Vocabulary:
    """What a model file says: pieces with ids and scores, byte pieces, and ids of the end and of unknown characters.

    Models that this agenda doesn't describe are a ValueError: other than merge-type ones, those with a normalisation beyond
    blanks, and those with user-defined or unused pieces.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError(f"{path} is no merge-type vocabulary")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError(f"{path} normalises texts beyond their blanks")
        kinds = {p.type for p in model.pieces}
        if kinds - {_NORMAL, _UNKNOWN, 3, _BYTE}:
            raise ValueError(f"{path} has user-defined or unused pieces")
        self.prefix = spec.add_dummy_prefix
        self.strings = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        scores = sorted({p.score for p in model.pieces if p.type == _NORMAL}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        #: Place of each longer piece in the order of scores, the best first; equal scores share a place.
        self.place = {p.piece: order[p.score] for p in model.pieces if p.type == _NORMAL and len(p.piece) > 1}
        self.longest = max(map(len, self.place), default=1)
        fallback = model.trainer_spec.byte_fallback
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE} if fallback else {}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        self.unknown_text = model.trainer_spec.unk_surface
        self.end = next((i for i, p in enumerate(model.pieces) if p.type == 3 and p.piece == model.trainer_spec.eos_piece), None)
        self.control = {i for i, p in enumerate(model.pieces) if p.type == 3}


def merge(text: str, vocabulary: Vocabulary) -> list[str]:
    """The symbols that a normalised text ends as."""
    n, place, longest = len(text), vocabulary.place, vocabulary.longest
    symbols: list[str | None] = list(text)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    # an entry is its pair's place in the order of scores, then its left symbol's position, as one number
    agenda = [place[two] << 32 | i for i in range(n - 1) if (two := text[i : i + 2]) in place]
    heapify(agenda)
    while agenda:
        entry = heappop(agenda)
        i = entry & 0xFFFFFFFF
        own = symbols[i]
        if own is None or (j := right[i]) >= n:
            continue
        joined = own + symbols[j]  # type: ignore[operator]  # a live symbol's right neighbour is live
        if place.get(joined) != entry >> 32:
            continue  # one of the two has grown since
        symbols[i], symbols[j] = joined, None
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if len(joined) + len(symbols[k]) <= longest and (found := place.get(joined + symbols[k])) is not None:  # type: ignore[arg-type,operator]
                heappush(agenda, found << 32 | i)
        k = left[i]
        if k >= 0 and len(joined) + len(symbols[k]) <= longest and (found := place.get(symbols[k] + joined)) is not None:  # type: ignore[arg-type,operator]
            heappush(agenda, found << 32 | k)
    return [s for s in symbols if s is not None]


def _groups(pieces: Iterable[str]) -> list[str]:
    """Characters other than the blank by whether pieces link them as neighbours, directly or not; the largest group first.

    All characters of a piece are in one group, so no merge joins two groups; characters of no longer piece are in none.
    """
    over: dict[str, str] = {}

    def top(c: str) -> str:
        while over.setdefault(c, c) != c:
            over[c] = c = over[over[c]]
        return c

    for piece in pieces:
        inner = piece.lstrip(BLANK)
        for a, b in zip(inner, inner[1:] or inner, strict=False):
            over[top(a)] = top(b)
    out: dict[str, list[str]] = {}
    for c in sorted(over):
        out.setdefault(top(c), []).append(c)
    return sorted(map("".join, out.values()), key=lambda g: (-len(g), g))


class _Stretches(dict):
    """Ids by stretch: a table of bounded bytes that computes what it lacks."""

    def __init__(self, vocabulary: Vocabulary):
        self._vocabulary, self._bytes = vocabulary, 0
        #: Stretches computed since this was last emptied, with their ids; None: they are not noted.
        self.fresh: list[tuple[str, tuple[int, ...]]] | None = None

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        v, ids = self._vocabulary, []
        for symbol in merge(stretch, v):
            known = v.ids.get(symbol)
            if known is not None:
                ids.append(known)
            elif v.byte_ids:
                ids += map(v.byte_ids.__getitem__, symbol.encode())
            else:
                ids.append(v.unknown)
        out = tuple(ids)
        if self.fresh is not None:
            self.fresh.append((stretch, out))
        if len(stretch) <= CACHED_CHARS:
            self._bytes += 250 + 2 * len(stretch) + 36 * len(out)  # a string, a tuple, their place in the table, and the numbers
            if self._bytes > CACHED_BYTES:
                self.clear()
                self._bytes = 0
            self[stretch] = out
        return out


class Encoder:
    """Encodes and decodes whole texts; no control piece is found in a text."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        known = v.place
        if not v.byte_ids or any(BLANK in piece.lstrip(BLANK) for piece in known):
            self.cuts = lambda text: [text]  # unknown characters side by side share one id, or merges reach across blanks
        else:
            inner = "".join(f"[{re.escape(group)}]+|" for group in _groups(known))
            self.cuts = re.compile(f"{BLANK}*(?:{inner.rstrip('|')})|{BLANK}+|.", re.S).findall if inner else list
        self.known = _Stretches(v)

    def stretches(self, text: str) -> list[str]:
        """A text normalised and cut."""
        text = text.replace(" ", BLANK)
        return self.cuts(BLANK + text if text and self.vocabulary.prefix else text)

    def encode(self, text: str, end: bool = True) -> list[int]:
        """Ids of a text, and of its end."""
        v = self.vocabulary
        if text:
            ids = list(chain.from_iterable(map(self.known.__getitem__, self.stretches(text))))
            if not v.byte_ids:
                ids = [x for k, x in enumerate(ids) if x != v.unknown or not k or ids[k - 1] != v.unknown]
        else:
            ids = []
        if end and v.end is not None:
            ids.append(v.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: without the blank before it and without control pieces; bytes that are no UTF-8 give U+FFFD each."""
        v, parts, raw = self.vocabulary, [], bytearray()
        first = v.prefix
        of_bytes, control, strings = v.bytes, v.control, v.strings
        for i in ids:
            if i in of_bytes:
                raw.append(of_bytes[i])
                continue
            if raw:
                parts.append(_characters(bytes(raw)))
                raw.clear()
                first = False
            if i in control:
                continue
            piece = v.unknown_text if i == v.unknown else strings[i]
            if first:
                first = False
                if i != v.unknown and piece.startswith(BLANK):
                    piece = piece[1:]
            parts.append(piece)
        if raw:
            parts.append(_characters(bytes(raw)))
        return "".join(parts).replace(BLANK, " ")


class Checked:
    """An encoder whose stretches are all compared with the library when they are first computed, a batch at a time.

    The library puts a blank before a text, so a stretch is given to it after a character that no merge reaches across.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.encoder, self.library = Encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
        merged = {c for piece in self.encoder.vocabulary.place for c in piece}
        self.before = next(c for c in map(chr, range(1, 0x110000)) if c not in merged)
        self.skip = len(self.library.encode(self.before))
        self.wrong: set[str] = set()

    def digest(self, texts: list[str]) -> Iterator[tuple[list[int], str, bool]]:
        """Ids and decoded form of each text, and whether the library agrees on all stretches of it and on that form."""
        known = self.encoder.known
        known.fresh = []
        ids = list(map(self.encoder.encode, texts))
        fresh, known.fresh = known.fresh, None
        theirs = self.library.encode([self.before + stretch for stretch, _ in fresh], num_threads=1)
        self.wrong.update(stretch for (stretch, own), found in zip(fresh, theirs, strict=True) if list(own) != found[self.skip :])
        for text, own in zip(texts, ids, strict=True):
            decoded = self.encoder.decode(own)
            agrees = decoded == self.library.decode(own) and (not self.wrong or self.wrong.isdisjoint(self.encoder.stretches(text)))
            yield own, decoded, agrees


def _characters(raw: bytes) -> str:
    """UTF-8 decoded, with U+FFFD for each byte that is part of no character."""
    out = ""
    while raw:
        try:
            return out + raw.decode()
        except UnicodeDecodeError as e:
            out += raw[: e.start].decode() + "�"
            raw = raw[e.start + 1 :]
    return out


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker, so that later tasks find most stretches known."""
    return Encoder(path)


@lru_cache(1)
def _checked(path: str) -> Checked:
    return Checked(path)


def _forget() -> None:
    _encoder.cache_clear()
    _checked.cache_clear()


keeps("piece_bpe", _forget)


def encode_documents(docs: DataFrame, model_path: str, end: bool = True) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs(doc_id, text)``, the end's id last.

    A null text counts as empty and has the end alone; a null doc_id is kept; repeated rows give repeated rows; an empty table
    gives none; other columns are ignored, whatever their names. One narrow pass: no shuffle, and a lost task is run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("piece_bpe")
        encoder = _encoder(model_path)
        for part in sliced(batches, "text", SLICE_BYTES, "piece_bpe"):
            ids = [encoder.encode(text.as_py() or "", end) for text in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return with_long_id(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` for every row of ``encoded(doc_id, ids)``; null ids count as an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("piece_bpe")
        encoder = _encoder(model_path)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [encoder.decode(ids or []) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return with_long_id(encoded.select("doc_id", "ids")).mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Round trip of every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256, agrees``, in one narrow pass.

    The digests are over the decimal ids joined by one space and over the UTF-8 form of the text that the ids decode to.
    ``agrees`` says whether the library gives the same ids for every stretch of the text (each is compared when it is first
    computed, an Arrow batch at a time) and decodes the text's ids to the same text; what the agenda found is returned in any
    case. Null and empty texts have the end's id alone; ids of documents, repeated rows, empty tables and other columns are as in
    :func:`encode_documents`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("piece_bpe")
        checked = _checked(model_path)
        names = list(map(str, range(len(checked.encoder.vocabulary.strings)))).__getitem__
        for batch in sliced(batches, "text", SLICE_BYTES, "piece_bpe"):
            sizes, of_ids, of_texts, agrees = [], [], [], []
            for ids, decoded, same in checked.digest([t or "" for t in batch.column(1).to_pylist()]):
                agrees.append(same)
                sizes.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(names, ids)).encode()).hexdigest())
                of_texts.append(hashlib.sha256(decoded.encode()).hexdigest())
            made = [pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string()), pa.array(agrees, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    return with_long_id(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")
