"""Vectorised kernels over the UTF-8 buffers of Arrow string columns.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D, so it is found on UTF-8 bytes directly. Words, lines and
windows are represented by 64-bit hashes; equal strings have equal hashes, and the reverse holds but for collisions of a
random 64-bit table hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from florilege.llm.worker import begin

#: Texts are worked on in slices of about this many bytes; temporaries take about 60 times that.
SLICE_BYTES = 1 << 19

_RNG = np.random.default_rng(20240229)
_BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        m = 1 << max(12, int(n - 1).bit_length())
        steps = np.full(m, _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, operator: str = "texts") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` has at most ``limit`` bytes in each, or one row; a task of ``operator`` begins."""
    begin(operator)
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def segment_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; all lengths must be positive and the ranges ascending and disjoint."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    codes = _BYTE_CODES[raw[np.repeat(starts, lengths) + within]]
    codes *= powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(codes, first) + lengths.astype(np.uint64))


class Words:
    """The words of a slice of documents: byte range, document and hash of each."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, lower: bool = False):
        self.raw, self.at = raw, at
        self.n_docs = len(at) - 1
        space = _SPACE[raw]
        edge = np.ones(len(raw) + 1, dtype=bool)
        edge[1:-1] = space[:-1]
        edge[at] = True  # a document's start, or the end of all
        body = ~space
        self.starts = np.flatnonzero(body & edge[:-1])
        ends = np.ones(len(raw) + 1, dtype=bool)
        ends[1:-1] = space[1:]
        ends[at] = True
        self.lengths = np.flatnonzero(body & ends[1:]) + 1 - self.starts
        self.first = np.searchsorted(self.starts, at)  # the number of the first word of each document, and of all
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        self.body = body
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        self.hashes = segment_hashes(raw, self.starts, self.lengths)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of each window of ``size`` words that lies in one document."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total *= _BASE
            total += self.hashes[k : k + n]
        start = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return start, mix(total[start])


def per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the byte range of each document."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where the same (document, hash) occurs at another place too."""
    if not len(h):
        return np.zeros(0, bool)
    order = np.lexsort((h, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    out = np.zeros(len(h), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def distinct_per_doc(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """Number of different hashes of each document."""
    if not len(h):
        return np.zeros(n_docs, np.int64)
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return np.bincount(d[new], minlength=n_docs)


def repeat_words(words: Words, size: int = 8) -> np.ndarray:
    """Words of each document that lie in a ``size``-word window found twice or more in it."""
    start, h = words.windows(size)
    hit = start[repeated(words.doc[start], h)]
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(words.doc[covered], minlength=words.n_docs)


def line_counts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and how many of them equal an earlier line, of each document; lines are split at \\n."""
    raw, at = words.raw, words.at
    if not len(words.starts):
        return np.zeros(words.n_docs, np.int64), np.zeros(words.n_docs, np.int64)
    breaks = np.flatnonzero(raw == 10)
    start = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], breaks + 1]))
    start = start[start < len(raw)]
    stop = np.append(start[1:], len(raw))
    last = stop - 1
    stop = np.where(raw[last] == 10, last, stop)  # the \n itself is no part of the line
    with_word = np.searchsorted(words.starts, stop) > np.searchsorted(words.starts, start)
    start, stop = start[with_word], stop[with_word]
    doc = np.searchsorted(at, start, "right") - 1
    lines = np.bincount(doc, minlength=words.n_docs)
    return lines, lines - distinct_per_doc(doc, segment_hashes(raw, start, stop - start), words.n_docs)
