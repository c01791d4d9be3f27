"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

The sketch of a statistic is a histogram over logarithmic bins (relative error ``SKETCH_ERROR``), kept as rows of
``(lang, source, stat, bin, n)``. Two sketches merge by adding counts, so Spark builds them with partial sums before the
shuffle, in any order, and the result does not depend on the partitioning; a source with a third of all rows is no hot key.
The sketches of a language, and of the whole corpus, are sums of those of its groups. Documents that fail the base rules are
in no sketch.

Every group's sketch is joined by ``PRIOR`` documents' worth of its language's, which has as many of the corpus's: a group of
few documents is judged nearly as its language, a large one by its own, without a size at which this changes.

A document is rejected if a statistic lies beyond its group's upper fence. All fences are read off the sketch, on its own
(logarithmic) scale; no statistic has a constant of its own:

* of statistics of the whole text (``BULK``), ``q75 * (q75 / q50) ** REACH``: with the quartile and median of a bell curve that
  is about six standard deviations. Up to a quarter of a group may be junk without moving its fence much;
* of statistics that most documents lack (``RARE``), so that quartiles say nothing, the quantile ``TAIL``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florilege.llm.docstats import extra_counts, rule_counts
from florilege.llm.storage import materialize
from florilege.llm.textkernels import Words, sliced, utf8

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Groups of language and source up to which their fences (about 150 bytes each) are broadcast.
BROADCAST_GROUPS = 50_000
SKETCH_ERROR = 0.01
#: Spreads of the upper half's quartile beyond which a text is no part of the bulk; the quantile kept of rare statistics.
REACH, TAIL = 8.0, 0.999
#: Documents for which the parent's sketch counts in that of a group.
PRIOR = 200
BULK, RARE = ("symbols", "upper", "word_length"), ("dup_lines", "repeats", "marks")
STATS = (*BULK, *RARE)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_GAMMA = (1 + SKETCH_ERROR) / (1 - SKETCH_ERROR)
#: Values at or below this share the sketch's zero bin: one character, line or word in a thousand.
_ZERO = 1e-3


def _measure(words: Words) -> tuple[dict[str, np.ndarray], np.ndarray]:
    base, more = rule_counts(words), extra_counts(words)
    n, chars = np.maximum(base["n_words"], 1), np.maximum(base["word_chars"], 1)
    stats = {
        "symbols": base["n_symbols"] / chars,
        "dup_lines": base["n_dup_lines"] / np.maximum(more["n_lines"], 1),
        "repeats": base["n_repeat_words"] / n,
        "upper": more["n_upper"] / chars,
        "marks": more["n_marks"] / chars,
        "word_length": base["word_chars"] / n,
    }
    return base, np.stack([stats[k] for k in STATS], axis=1)


def with_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and one column ``rule`` with the base counts and the statistics of ``text``; one narrow pass.

    A text that is kept is sent to Python once, and measured in its own column.
    """
    at = keep.index(text) if text in keep else len(keep)
    rule = T.StructType([T.StructField(c, T.LongType()) for c in BASE] + [T.StructField("stats", T.ArrayType(T.DoubleType()))])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("rule", rule)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, [*keep, "rule"][at]):
            base, stats = _measure(Words(*utf8(part.column(at))))
            lists = pa.ListArray.from_arrays(np.arange(0, stats.size + 1, len(STATS), dtype=np.int32), pa.array(stats.ravel()))
            made = pa.StructArray.from_arrays([*(pa.array(base[c]) for c in BASE), lists], [*BASE, "stats"])
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], made], [*keep, "rule"])

    return docs.select(*keep, *([F.col(text).alias("rule")] if at == len(keep) else [])).mapInArrow(run, schema)


def sketch(stats: DataFrame) -> DataFrame:
    """Sketches by ``lang, source, stat`` of the rows of :func:`with_stats` that pass the base rules: ``lang, source, stat, bin, n``."""
    bins = F.transform("rule.stats", lambda x: F.when(x > _ZERO, F.ceil(F.log(x / _ZERO) / math.log(_GAMMA))).otherwise(0).cast("int"))
    rows = stats.where(~base_failed()).select("lang", "source", F.posexplode(bins).alias("stat", "bin"))
    return rows.groupBy("lang", "source", "stat", "bin").agg(F.count("*").alias("n"))


def place(bins: np.ndarray, weight: np.ndarray, p: float) -> float:
    """The quantile p of a sketch, in bins above the zero bin, as if a bin's values were spread evenly over it."""
    order = np.argsort(bins, kind="stable")
    bins, total = bins[order], np.cumsum(weight[order])
    k = int(np.searchsorted(total, p * total[-1]))
    k = min(k, len(bins) - 1)
    if not bins[k]:
        return 0.0
    low = int(np.searchsorted(bins, bins[k]))  # a bin may be there more than once
    high = int(np.searchsorted(bins, bins[k], "right")) - 1
    below = total[low - 1] if low else 0.0
    return float(bins[k] - 1 + min(1.0, (p * total[-1] - below) / (total[high] - below)))


def fence(stat: int, bins: np.ndarray, weight: np.ndarray) -> float:
    """The upper fence of the statistic of this number, from a sketch."""
    if STATS[stat] in RARE:
        return _ZERO * _GAMMA ** place(bins, weight, TAIL)
    q50, q75 = place(bins, weight, 0.5), place(bins, weight, 0.75)
    return _ZERO * _GAMMA ** min(q75 + REACH * (q75 - q50), 100_000.0)


def blended(own: tuple[np.ndarray, np.ndarray], parent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bins and weights of a sketch together with ``PRIOR`` documents' worth of its parent's."""
    share = parent[1] * (PRIOR / parent[1].sum())
    return np.concatenate([own[0], parent[0]]), np.concatenate([own[1], share])


def fences(sketches: DataFrame) -> DataFrame:
    """One row per ``lang, source`` with ``fences array<double>`` in the order of ``STATS``.

    Nulls are groups of their own. A group's sketch is one row of at most some thousand bins, whatever its documents. The
    corpus's sketch, as small, goes through the driver. ``sketches`` is read more than once: pass a written table.
    """
    bins = F.collect_list(F.struct("stat", "bin", "n"))
    group = sketches.groupBy("lang", "source").agg(bins.alias("own"))
    lang = sketches.groupBy("lang", "stat", "bin").agg(F.sum("n").alias("n")).groupBy(F.col("lang").alias("of")).agg(bins.alias("parent"))
    whole = np.array([tuple(r) for r in sketches.groupBy("stat", "bin").agg(F.sum("n").alias("n")).collect()], float).reshape(-1, 3)  # bounded: bins of a few statistics

    def of(table: np.ndarray, stat: int) -> tuple[np.ndarray, np.ndarray]:
        rows = table[table[:, 0] == stat]
        return rows[:, 1], rows[:, 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda value: np.stack([np.asarray(value.values.field(c), float) for c in ("stat", "bin", "n")], axis=1)
        for batch in batches:
            out = []
            for own, parent in zip(batch.column(2), batch.column(3), strict=True):
                own, parent = read(own), read(parent)
                out.append([fence(k, *blended(of(own, k), blended(of(parent, k), of(whole, k)))) for k in range(len(STATS))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.float64()))], ["lang", "source", "fences"])

    both = group.join(lang, group["lang"].eqNullSafe(lang["of"])).select("lang", "source", "own", "parent")
    schema = T.StructType([sketches.schema["lang"], sketches.schema["source"], T.StructField("fences", T.ArrayType(T.DoubleType()))])
    return both.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("rule.n_words") < MIN_WORDS) | (100 * F.col("rule.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("rule.n_words"))


def judged(stats: DataFrame, fence_rows: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to rows of :func:`with_stats`, by a join with the fences of their group.

    The fences are broadcast if a count shows them to be few, so that documents stay where they are. A group without fences has
    no document that passes the base rules.
    """
    f = materialize(fence_rows, "fences").select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), "fences")
    if f.count() <= BROADCAST_GROUPS:
        f = F.broadcast(f)
    joined = stats.join(f, stats["lang"].eqNullSafe(f["fence_lang"]) & stats["source"].eqNullSafe(f["fence_source"]), "left")
    beyond = F.coalesce(F.exists(F.arrays_zip(F.col("rule.stats").alias("x"), F.col("fences").alias("f")), lambda p: p["x"] > p["f"]), F.lit(False))
    failed = base_failed()
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~beyond).drop("fence_lang", "fence_source", "fences")


def judge_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang, source)``: the base counts, ``base_failed`` and ``kept``.

    A null text counts as empty: no words, so ``base_failed``. Null languages and sources are groups like any other.
    Repeated rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    stats = materialize(with_stats(docs, ["doc_id", "lang", "source"]), "rules")
    return judged(stats, fences(materialize(sketch(stats), "sketch"))).select("doc_id", *(F.col(f"rule.{c}").alias(c) for c in BASE), "base_failed", "kept")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Texts are measured twice, once for the sketches and once beside the text, rather than shuffled.
    """
    lean = materialize(sketch(with_stats(docs, ["lang", "source"])), "sketch")
    columns = [f"c{i}" for i in range(len(docs.columns))]  # names of our own cannot clash
    renamed = docs.toDF(*columns)
    at = dict(zip(docs.columns, columns, strict=True))
    rows = renamed.withColumns({"lang": F.col(at["lang"]), "source": F.col(at["source"])})
    return judged(with_stats(rows, [*columns, "lang", "source"], at["text"]), fences(lean)).where("kept").select(*columns).toDF(*docs.columns)
