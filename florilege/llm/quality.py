"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a Gaussian with its mean and a covariance shrunk towards the pooled one and a scaled identity. The score is
the logistic of the difference of the two log densities, by Mahalanobis distances with Cholesky factors that are computed and
inverted once, and of the log prior odds. Moments are exact sums over all training rows, added up per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florilege.llm.docstats import extra_counts, rule_counts
from florilege.llm.idfilter import split_by_ids
from florilege.llm.storage import materialize
from florilege.llm.textkernels import Words, sliced, utf8

THRESHOLD = 0.3
#: Shares of the pooled covariance and of the scaled identity in each class covariance.
POOLED, IDENTITY = 0.05, 0.01
#: Labels of 12 bytes up to which they are broadcast.
BROADCAST_LABELS = 500_000
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "marks", "stops", "digits", "distinct", "line_words", "word_spread"]


def features(words: Words) -> np.ndarray:
    """Transformed statistics, one row per document; an empty text has defined values too."""
    base, more = rule_counts(words), extra_counts(words)
    n = base["n_words"].astype(float)
    chars, some = np.maximum(base["word_chars"], 1), np.maximum(n, 1)
    squares = np.bincount(words.doc, words.lengths.astype(float) ** 2, minlength=words.n_docs) / some
    mean = np.bincount(words.doc, words.lengths.astype(float), minlength=words.n_docs) / some
    out = [
        np.log1p(n),
        np.log1p(base["word_chars"] / some),
        np.log(base["n_symbols"] / chars + 0.003),
        np.log(base["n_dup_lines"] / np.maximum(more["n_lines"], 1) + 0.03),
        np.log(base["n_repeat_words"] / some + 0.03),
        np.log(more["n_upper"] / chars + 0.01),
        np.log(more["n_marks"] / chars + 0.003),
        np.log(more["n_stops"] / some + 0.03),
        np.log(more["n_digits"] / chars + 0.003),
        np.log((more["n_distinct"] + 1) / (n + 1)) / np.log(n + 3),
        np.log1p(n / np.maximum(more["n_lines"], 1)),
        0.5 * np.log1p(np.maximum(squares - mean**2, 0)),
    ]
    return np.stack(out, axis=1)


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``qf array<double>`` of ``text``; one narrow pass."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("qf", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "qf"):
            x = features(Words(*utf8(part.column(len(keep)))))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists], [*keep, "qf"])

    return docs.select(*keep, F.col("text").alias("qf")).mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Two Gaussians: means, inverses of the Cholesky factors and half the logarithms of the determinants.

    Without two training rows of each class every score is the prior's.
    """

    prior: float
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    halves: list[float]

    @classmethod
    def fit(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
        """From each class's count, sum and sum of outer products."""
        counts = [moments[k][0] if k in moments else 0.0 for k in (0, 1)]
        total = sum(counts)
        prior = (counts[1] + 1) / (total + 2)
        if min(counts) < 2:
            return cls(prior, [], [], [])
        means = [moments[k][1] / counts[k] for k in (0, 1)]
        scatter = [moments[k][2] - counts[k] * np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = (scatter[0] + scatter[1]) / total
        unit = np.diag(np.maximum(np.diag(pooled), 1e-6))  # an identity on the scale of each feature
        factors = [np.linalg.cholesky((1 - POOLED - IDENTITY) * scatter[k] / counts[k] + POOLED * pooled + IDENTITY * unit) for k in (0, 1)]
        return cls(prior, means, [np.linalg.inv(f) for f in factors], [float(np.log(np.diag(f)).sum()) for f in factors])

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), np.log(self.prior / (1 - self.prior)))
        for sign, mean, inverse, half in zip((-1, 1), self.means, self.inverses, self.halves, strict=False):
            z = (x - mean) @ inverse.T
            odds += sign * (-0.5 * (z * z).sum(1) - half)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on all rows of ``rows(doc_id, qf)`` with a label 0 or 1 that are not held out.

    Only the moments of two classes reach the driver. Null labels and ids, and labels other than 0 and 1, do not train; repeated
    rows count each. Up to ``BROADCAST_LABELS`` labels are broadcast; with more, a bitmap of their ids picks the rows that
    are joined. ``labels`` is read more than once.
    """
    d = len(FEATURES)
    known = labels.where(F.col("quality").cast("double").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out())
    label = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    few = label.count() <= BROADCAST_LABELS
    rows = rows if few else split_by_ids(rows, "doc_id", label.withColumnRenamed("doc_id", "labelled_id"), "labelled_id")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for batch in batches:
            y, x = np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten()).reshape(-1, d)
            for k, s in sums.items():
                own = x[y == k]
                s += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        n = 1 + d + d * d
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], n), pa.int32()), pa.array(np.tile(np.arange(n), 2), pa.int32()), pa.array(np.concatenate([sums[0], sums[1]]))], ["k", "i", "v"])

    train = rows.select("doc_id", "qf").join(F.broadcast(label) if few else label, "doc_id").select("quality", "qf")
    found = train.mapInArrow(run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d^2) rows
    by = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for k, i, v in found:
        by[k][i] = v
    return Discriminant.fit({k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in by.items()})


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    """Replace ``qf`` by ``score`` and ``predicted``."""
    keep = [c for c in rows.columns if c != "qf"]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(np.asarray(batch.column(len(keep)).flatten()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    return rows.select(*keep, "qf").mapInArrow(run, schema)


def classify_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; null and empty texts are scored too.

    Labels are learned from rows that are not held out alone; lang, source, doc_id and labels are no inputs of a score. Repeated
    rows are scored each; a null doc_id hashes as an empty name; an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(with_features(docs, ["doc_id"]), "features")
    return scored(rows, fit(rows, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def filter_documents(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted to be of quality 1, with all their columns; texts are never shuffled.

    The classes are learned from the documents of ``labelled``, which should be the corpus before any other filter: what an
    earlier stage has removed is what the model needs examples of. Null and empty texts are scored as any other; repeated rows
    stay or go together; an empty table stays empty, and columns may have any names.
    """
    model = fit(materialize(with_features(labelled, ["doc_id"]), "features"), labels)
    at = docs.columns.index("text")
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may repeat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, f"c{at}"):
            yield part.filter(pa.array(model.score(features(Words(*utf8(part.column(at))))) >= THRESHOLD))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
