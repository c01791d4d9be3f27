"""Numpy kernels behind the Arrow operators: word windows, tokens and hashed features of many texts at a time."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

_WORD = re.compile(rb"[^ \n\t\r]+")
_TOKEN = re.compile(rb"[a-z0-9_]+")
_FOLD = {0x130: "i", 0x212A: "k"}  # the only characters beyond ASCII whose lower case is ASCII
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_BREAK, _IN_TOKEN = np.isin(_BYTES, list(b" \n\t\r")), np.isin(_BYTES, list(b"abcdefghijklmnopqrstuvwxyz0123456789_"))
#: Unicode White_Space.
WHITE_SPACE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def windows(text: str, size: int, step: int) -> list[tuple[int, int, str]]:
    """Byte start and end and trimmed text of each window of words; windows without text are left out.

    Windows begin every ``step`` words, and the first that reaches the last word is the last. Linear in the text.
    """
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(raw)]
    out = []
    for first in range(0, len(spans), step):
        last = min(first + size, len(spans))
        start, end = spans[first][0], spans[last - 1][1]
        if part := raw[start:end].decode("utf-8", "replace").strip(WHITE_SPACE):
            out.append((start, end, part))
        if last == len(spans):
            break
    return out


def tokens(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and underscores of the lowered text."""
    if not text.isascii():
        text = text.translate(_FOLD)
    return _TOKEN.findall(text.encode("utf-8", "replace").lower())


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values begin and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return edges[::2], edges[1::2]


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts with a line end between them, and where each begins and ends."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(length + 1) - 1
    return b"\n".join(texts), end - length, end


def cut(raw: bytes, begin: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of the windows of :func:`windows`, of texts that begin at ``begin``; those without text are among them."""
    start, end = _runs(~_BREAK[np.frombuffer(raw, np.uint8)])
    first = np.searchsorted(start, begin)
    words = np.diff(np.append(first, len(start)))
    n = np.minimum(-(-words // step), 1 + -(-np.maximum(words - size, 0) // step))
    text = np.repeat(np.arange(len(begin)), n)
    low = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step
    return text, start[first[text] + low], end[first[text] + np.minimum(low + size, words[text]) - 1]


def fnv1a(strings: list[bytes]) -> np.ndarray:
    """32-bit FNV-1a of each string."""
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    return hashed(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(length) - length, length)


def hashed(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: np.ndarray | None = None) -> np.ndarray:
    """32-bit FNV-1a of stretches of bytes, going on from ``seed``; one vector step per byte position."""
    most = int(length.max(initial=0))
    order = np.argsort(-length.astype(np.int16 if most < 32768 else np.int64), kind="stable")
    start = start[order]
    h = np.full(len(start), 2166136261, np.uint32) if seed is None else seed[order]
    for k, n in enumerate(np.searchsorted(-length[order], -np.arange(most), "left")):
        h[:n] = (h[:n] ^ data[start[:n] + k]) * np.uint32(16777619)
    out = np.empty_like(h)
    out[order] = h
    return out


def _within(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches that begin at ``low`` and have n places: the stretch of each place, and the place."""
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n - low, n)


def stretches(strings: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of strings where they are, and where each begins and how long it is; no string becomes a Python object."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64) if len(strings) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at[:-1], np.diff(at)


class Indexed:
    """Tokens of stretches of bytes, told apart exactly: their numbers, and from these term counts and hashed features.

    ``start`` and ``end`` rise, and no token reaches across either; stretches may overlap. Tokens are found once in all of it.
    """

    def __init__(self, raw: bytes, start: np.ndarray, end: np.ndarray):
        low = int(start[0]) if len(start) else 0
        some = np.frombuffer(raw, np.uint8)[low : int(end.max(initial=low))]
        lower = _LOWER[some]
        kept = _IN_TOKEN[lower]
        inside = kept
        for char, small in _FOLD.items():  # such a character counts as one small letter
            code = chr(char).encode()
            at = np.flatnonzero(some[: len(some) - len(code) + 1] == code[0]) if len(some) >= len(code) else np.zeros(0, np.int64)
            for k in range(1, len(code)):
                at = at[some[at + k] == code[k]]
            if len(at):
                inside = inside.copy() if inside is kept else inside
                lower[at], kept[at] = ord(small), True
                for k in range(len(code)):
                    inside[at + k] = True
        first, last = _runs(inside)
        before = np.concatenate([[0], np.cumsum(kept)])
        self.data = lower[kept]
        offsets = np.append(before[first], len(self.data)).astype(np.int32)
        strings = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(self.data)]).dictionary_encode()
        self.number, self.words = np.asarray(strings.indices), strings.dictionary
        self.low = np.searchsorted(first, start - low)
        self.n = np.searchsorted(first, end - low) - self.low

    def terms(self) -> pa.ListArray:
        """Distinct tokens with their counts, of each stretch."""
        own, at = _within(self.low, self.n)
        some = max(1, len(self.words))
        key, count = np.unique(own * some + self.number[at], return_counts=True)
        lists = np.searchsorted(key // some, np.arange(len(self.n) + 1)).astype(np.int32)
        flat = [self.words.cast(pa.string()).take(pa.array(key % some)), pa.array(count.astype(np.int32))]
        return pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays(flat, ["term", "tf"]))

    def counts(self, dim: int) -> np.ndarray:
        """Tokens and neighbouring pairs, joined by an underscore, of each stretch by bucket."""
        data, start, length = stretches(self.words)
        h = hashed(data, start, length)
        a, b = self.number[:-1], self.number[1:]
        pair = hashed(data, start[b], length[b], (h[a] ^ np.uint32(95)) * np.uint32(16777619)) % np.uint32(dim)
        own, at = _within(self.low, self.n)
        out = np.bincount(own * dim + (h % np.uint32(dim))[self.number[at]], minlength=len(self.n) * dim)
        own, at = _within(self.low, np.maximum(self.n - 1, 0))
        return (out + np.bincount(own * dim + pair[at], minlength=len(self.n) * dim)).reshape(len(self.n), dim)

    def vectors(self, dim: int) -> np.ndarray:
        """Log frequencies of features by bucket, scaled to length 1 in single precision; zero without tokens."""
        count = self.counts(dim)
        weight = np.zeros(count.shape)
        some = count > 0
        weight[some] = 1 + np.log(count[some])
        norm = np.add.accumulate(weight * weight, axis=1)[:, -1]
        scale = np.divide(1, np.sqrt(norm), out=np.zeros(len(norm)), where=norm > 0)
        return weight.astype(np.float32) * scale.astype(np.float32)[:, None]


def lists(rows: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
