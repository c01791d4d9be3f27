"""Byte-level BPE encoding and decoding by ranks, with a segment tree over byte positions.

``encode_bytes`` keeps one leaf per byte position that holds the rank of the pair starting there; inner nodes hold the
leftmost position of the least rank below them. A merge takes the root's position, joins the two live neighbours and
updates two leaves and one removed leaf, each in logarithmic time, so a piece of n bytes takes O(n log n).

Pieces (matches of the pre-tokenizer's pattern) repeat a lot, so their ids are kept in a table of bounded bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from florilege.llm.ids import with_long_id
from florilege.llm.textkernels import sliced
from florilege.llm.worker import begin, keeps

#: Bytes that kept pieces and their ids may take in a worker, about; the longest of them in characters; bytes of texts at a time.
CACHED_BYTES, CACHED_CHARS, SLICE_BYTES = 320 << 20, 48, 4 << 20
_NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encode_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece; an empty piece has none."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece[i : i + 1]] for i in range(n)]
    size = 1 << (n - 1).bit_length()
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))  # live neighbours by position; right[i] is also i's end
    rank = [_NONE] * size
    for i in range(n - 1):
        rank[i] = ranks.get(piece[i : i + 2], _NONE)
    tree = [0] * size + list(range(size))
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if rank[a] <= rank[b] else b

    def update(i: int, value: int) -> None:
        if rank[i] == value:
            return
        rank[i] = value
        k = (size + i) >> 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if rank[a] <= rank[b] else b
            k >>= 1

    def pair(i: int) -> int:
        j = right[i]
        return ranks.get(piece[i : right[j]], _NONE) if j < n else _NONE

    while rank[i := tree[1]] != _NONE:
        gone = right[i]
        right[i] = right[gone]
        if right[gone] < n:
            left[right[gone]] = i
        update(gone, _NONE)
        update(i, pair(i))
        if left[i] >= 0:
            update(left[i], pair(left[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : right[i]]])
        i = right[i]
    return out


class _Pieces(dict):
    """Ids by piece: a table of bounded bytes that computes what it lacks."""

    def __init__(self, ranks: dict[bytes, int]):
        self._ranks, self._bytes = ranks, 0

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(encode_bytes(piece.encode(), self._ranks))
        if len(piece) <= CACHED_CHARS:
            self._bytes += 210 + len(piece) + 36 * len(ids)  # a string, a tuple, their place in the table, and the numbers
            if self._bytes > CACHED_BYTES:
                self.clear()
                self._bytes = 0
            self[piece] = ids
        return ids


class Encoder:
    """Encodes and decodes whole texts as the pattern and ranks say; no special tokens exist."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self._known = _Pieces(ranks)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._known.__getitem__, self.pieces(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(1)
def _encoder(rank_path: str, pattern: str) -> Encoder:
    """One for all tasks of a worker, so that later tasks find most pieces known."""
    return Encoder(load_ranks(rank_path), pattern)


@lru_cache(1)
def _tokens(rank_path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(rank_path).items()}


def _forget() -> None:
    _encoder.cache_clear()
    _tokens.cache_clear()


keeps("byte_bpe", _forget)


def encode_documents(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs(doc_id, text)``.

    A null text counts as empty and gives an empty list; a null doc_id is kept, and one of another than an integer type is a
    TypeError; repeated rows give repeated rows; an empty table gives none; other columns are ignored. One narrow pass: no shuffle, and a lost task is simply run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("byte_bpe")
        batches = sliced(batches, "text", SLICE_BYTES, "byte_bpe")
        encoder = _encoder(rank_path, pattern)
        for part in batches:
            ids = [encoder.encode(text or "") for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return with_long_id(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, rank_path: str) -> DataFrame:
    """``doc_id, bytes`` for every row of ``encoded(doc_id, ids)``; null ids count as an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("byte_bpe")
        tokens = _tokens(rank_path)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                raw = [b"".join(map(tokens.__getitem__, ids or ())) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return with_long_id(encoded.select("doc_id", "ids")).mapInArrow(run, "doc_id long, bytes binary")


def digest_documents(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Round trip of every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, in one narrow pass.

    The digests are over the decimal ids joined by commas and over the bytes that the ids decode to. Null and empty texts
    have no tokens; ids of documents, repeated rows, empty tables and other columns are as in :func:`encode_documents`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("byte_bpe")
        batches = sliced(batches, "text", SLICE_BYTES, "byte_bpe")
        encoder = _encoder(rank_path, pattern)
        names = {rank: str(rank) for rank in encoder.tokens}.__getitem__
        for batch in batches:
            sizes, of_ids, of_bytes = [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "")
                sizes.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return with_long_id(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
