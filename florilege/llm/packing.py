"""Packing token sequences: best-fit decreasing with a segment tree indexed by remaining capacity.

1. Each document is tokenized and closed by an end id. Documents over the window are cut into full windows first; the last
   cut is an ordinary piece.
2. A full window is a sequence of its own. The other pieces are dealt by hash into shards of a few thousand pieces, so that
   no task grows with the corpus; in each shard the pieces go, longest first, into the tightest open sequence that they fit.
   What a shard leaves open is about one window, so the padding is near that of one global packing.
"""

from __future__ import annotations

import json
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.ids import with_long_id
from florilege.llm.storage import materialize
from florilege.llm.textkernels import sliced
from florilege.llm.worker import begin, keeps

WINDOW, END_ID = 4096, 2
#: Pieces of a shard on average.
SHARD_PIECES = 4096
#: Chunks of each of two generations whose ids are kept, and the longest of them in characters.
CACHED_CHUNKS, CACHED_CHARS = 250_000, 48
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long"


class BestFit:
    """Open sequences by remaining capacity, under a segment tree that finds the least capacity of at least a given one."""

    def __init__(self, window: int):
        self.window = window
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)  # open sequences below each node; leaf i: with i tokens left
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]
        self.sequences = 0

    def _add(self, capacity: int, n: int) -> None:
        node = self.size + capacity
        while node:
            self.count[node] += n
            node >>= 1

    def tightest(self, length: int) -> int:
        """The least capacity >= length of an open sequence, or -1."""
        node = self.size + length
        if self.count[node]:
            return length
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset of a piece; opens a sequence if none has room."""
        capacity = self.tightest(length)
        if capacity < 0:
            sequence, offset, capacity = self.sequences, 0, self.window
            self.sequences += 1
        else:
            sequence, offset = self.open[capacity].pop()
            self._add(capacity, -1)
        if capacity > length:
            self.open[capacity - length].append((sequence, offset + length))
            self._add(capacity - length, 1)
        return sequence, offset


def pack_lengths(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Sequence and offset of each piece, by best fit decreasing; equal lengths keep their order."""
    fit, out = BestFit(window), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = fit.place(lengths[i])
    return out


_MARKS = ",.;:!?"
#: Letters below this one are their own composed form, and lower-case one by one.
_LATIN_END = chr(0x130)
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The byte-level alphabet: bytes that print stand for themselves, the others for the characters from 256 on.
_BYTE_LEVEL = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are packed as little-endian 32-bit numbers")


#: The parts of a tokenizer file for which texts may be tokenized chunk by chunk between spaces and newlines.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def by_chunks(spec: dict) -> bool:
    """Whether a tokenizer lowers case, takes runs of letters or marks as pre-tokens, maps bytes without regard to what is before,
    merges without chance, and has no added token that could stand in a chunk without a <."""
    split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    bytes_ = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    return (
        (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", _SPLIT, "Removed", True)
        and len(rest) == 1 and bytes_.items() <= rest[0].items()
        and _MODEL.items() <= {"type": "BPE", **spec["model"]}.items()
        and all("<" in t["content"] for t in spec.get("added_tokens") or ())
        and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")
    )


def _ends_in_letter(core: str) -> bool:
    """Whether the last character is a letter or number and stays one: a few are normalized or lowered to a letter with a mark."""
    last = core[-1:]
    return last.isalnum() and (last < _LATIN_END or unicodedata.normalize("NFC", last).lower()[-1].isalnum())


class ChunkTokenizer:
    """Token ids as little-endian 32-bit bytes, joined from those of the chunks between spaces and newlines.

    Of a tokenizer for which :func:`by_chunks` does not hold, whole texts are encoded instead.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.in_chunks = by_chunks(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self._merge = self.tokenizer.model.tokenize
        self._known = _Chunks(self._ids)
        self._known[""] = b""

    def _ids(self, chunk: str) -> tuple[bytes, bool]:
        """Ids of a chunk, and whether to keep them.

        Trailing marks are pre-tokens of their own, and case makes no difference to ASCII. So a chunk with marks or capitals is
        made from its plain core, and kept only if the core had come before: most chunks come once.
        """
        if "<" not in chunk:  # no special token's string
            core = chunk.rstrip(_MARKS)
            marks = chunk[len(core) :] if _ends_in_letter(core) else ""
            plain = chunk[: len(chunk) - len(marks)]
            if plain.isascii() or (plain.isalpha() and max(plain) < _LATIN_END):
                plain = plain.lower()
            if plain != chunk:
                seen = plain in self._known
                return (self._known[plain] + self._known[marks] if marks else self._known[plain]), seen
            if plain.isalpha() and max(plain) < _LATIN_END:  # one pre-token that the normalizer leaves alone
                mapped = plain if plain.isascii() else plain.encode().decode("latin-1").translate(_BYTE_LEVEL)
                return array("I", [t.id for t in self._merge(mapped)]).tobytes(), len(chunk) <= CACHED_CHARS
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes(), len(chunk) <= CACHED_CHARS

    def encode(self, text: str) -> bytes:
        if not self.in_chunks:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self._known.__getitem__, text.replace("\n", " ").split(" ")))


class _Chunks(dict):
    """A table of bounded size that computes what it lacks; when it is full, what was not used lately goes."""

    def __init__(self, compute):
        self._compute, self._older = compute, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self._older.get(chunk)
        if ids is None:
            ids, keep = self._compute(chunk)
            if not keep:
                return ids
        if len(self) >= CACHED_CHUNKS:
            self._older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


@lru_cache(1)
def _tokenizer(path: str) -> ChunkTokenizer:
    """One for all tasks of a worker, so that later tasks find most chunks known."""
    return ChunkTokenizer(path)


keeps("packing", _tokenizer.cache_clear)


def cut_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of every row of ``docs(doc_id, text)``: ``doc_id, start, length, ids_crc32, doc_tokens, place``.

    ``place`` tells pieces apart, however often a document is repeated. A null or empty text is a document of the end id alone. Every id lies in exactly one piece; all pieces of a document but
    the last fill a window. Repeated rows are packed as often as they come. Narrow: no shuffle.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing")
        tokenizer = _tokenizer(tokenizer_path)
        n = None
        for batch in sliced(batches, "text", 4 << 20, "packing"):
            n = batch.column(2)[0].as_py() << 40 if n is None else n
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                raw = tokenizer.encode(text.as_py() or "") + end
                total = len(raw) // 4
                for start in range(0, total, window):
                    piece = raw[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total, n))
                    n += 1
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split(" ")[0] for c in PIECES.split(", ")])

    return with_long_id(docs.select("doc_id", "text")).withColumn("task", F.spark_partition_id()).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id, offset`` to pieces of 1 to ``window`` tokens.

    Offsets in a sequence are gapless from 0. Full windows take ids of their own without a shuffle; the rest goes through
    best-fit shards. ``pieces`` is read more than once: pass a written table. Shards hold their rows sorted, so a task that
    is run again gives the same sequences.
    """
    full, rest = pieces.where(F.col("length") >= window), pieces.where(F.col("length") < window)
    shards = max(1, -(-rest.count() // shard_pieces))
    key = F.pmod(F.xxhash64("place"), F.lit(shards))  # equal pieces have different places

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("place", "ascending")])
        fit = BestFit(window)
        placed = [fit.place(n) for n in table.column("length").to_pylist()]
        base = (2 * key[0].as_py()) << 31
        table = table.append_column("sequence_id", pa.array([base + s for s, _ in placed], pa.int64()))
        return table.append_column("offset", pa.array([o for _, o in placed], pa.int64())).drop_columns(["shard"])

    packed = rest.withColumn("shard", key).groupBy("shard").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")
    # odd upper halves: apart from the shards' ids, and unique by partition and row
    alone = full.withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone).drop("place")


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Tokenize, cut and pack: one row per piece of ``docs(doc_id, text)`` with its sequence and offset.

    A null text counts as empty and has the end's id alone; a null doc_id is kept, and one of another than an integer type is a
    TypeError; repeated rows are packed each; an empty table gives no rows; other columns are ignored. Which pieces share a
    sequence depends on how rows are dealt into tasks, their ids and padding do not.
    """
    return pack(materialize(cut_documents(docs, tokenizer_path, window, end_id), "pieces"), window, shard_pieces)
