"""The k best chunks of each question, kept in a task while scores stream past."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Best:
    """Of each question the k best rows by score to nine digits, then by id; at most five times k are held."""

    def __init__(self, questions: int, k: int):
        self.n, self.k = questions, k
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0
        self.floor = np.full(questions, -np.inf)  # rounded score of the worst of k kept

    def meet(self, names: pa.Array, score: np.ndarray) -> None:
        """Scores of each question (a row) with each chunk; minus infinity where a chunk doesn't count."""
        n, key = len(names), np.round(score, 9)
        least = np.maximum(self.floor, np.partition(key, n - self.k, axis=1)[:, n - self.k]) if n > self.k else self.floor
        q, at = np.nonzero((key >= least[:, None]) & (key > -np.inf))
        if not len(q):
            return
        some, own = np.unique(at, return_inverse=True)  # few chunks of a slice are among the best, and only their names are made
        self.kept.append((q, np.array(names.take(pa.array(some)).to_pylist(), dtype=object)[own], score[q, at]))
        self.waiting += len(q)
        if self.waiting > 4 * self.k * self.n:
            self._cut()

    def _cut(self) -> None:
        rows = _cut(tuple(np.concatenate(c) for c in zip(*self.kept, strict=True)), self.k)
        self.kept, self.waiting = [rows], 0
        full = np.bincount(rows[0], minlength=self.n) >= self.k
        worst = np.full(self.n, np.inf)
        np.minimum.at(worst, rows[0], np.round(rows[2], 9))
        self.floor = np.where(full, worst, -np.inf)

    def found(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Question, chunk and score."""
        if self.kept:
            self._cut()
        q, names, score = self.kept[0] if self.kept else (np.zeros(0, np.int64), [], np.zeros(0))
        return q, pa.array(names, pa.string()), score


def _cut(rows: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    q, names, score = rows
    order = np.lexsort((names.astype(str), -np.round(score, 9), q))
    q = q[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[keep], names[order][keep], score[order][keep]
