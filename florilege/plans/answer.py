"""Answering: retrieval, the confidence guardrail, citations and generators, one row per question."""

from __future__ import annotations

import json
import os
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions import scores
from florilege.functions.text import snippet
from florilege.operators.chunk import DIM, embed_texts
from florilege.operators.fusion import Retriever, fuse
from florilege.operators.keyword import KeywordIndex
from florilege.operators.vector import cosine_top_k
from florilege.schema import AnswerOptions, checked_top_k
from florilege.sources.folders import among, written

#: The sentence of a refusal, and bytes of snippets and passages.
REFUSAL = "I can't find anything in the indexed documents that answers this confidently. Try rephrasing, or check the question is covered by what's in this collection."
NO_CONTEXT = "No relevant context was found."
FOOTER = "(Local extractive mode: passages are quoted as they are; set up a generator for written answers.)"
SNIPPET_BYTES, PASSAGE_BYTES = 220, 400
#: Questions that a task has called for before it gives any on.
CALLED_ROWS = 256
SYSTEM = "Answer using ONLY the numbered source passages. Cite them by number. If they do not hold the answer, say so."


class Generator(Protocol):
    """Adds a column ``text`` with the answer, and maybe ``error``, to rows ``query_id, question, passages array<struct<path, text>>``."""

    name: str

    def answer(self, asked: DataFrame) -> DataFrame: ...


class Extractive:
    """Quotes the passages; a string expression, so nothing leaves the JVM."""

    name = "extractive-local"

    def answer(self, asked: DataFrame) -> DataFrame:
        return asked.withColumn("text", extractive_text(F.col("passages")))


def extractive_text(passages: Column) -> Column:
    """The passages, numbered, between a head with their number and a foot."""
    line = lambda p, i: F.concat((i + 1).cast("string"), F.lit(". ("), p["path"], F.lit(") "), snippet(p["text"], PASSAGE_BYTES), F.lit("\n\n"))
    body = F.array_join(F.transform(passages, line), "")
    whole = F.concat(F.lit("Based on "), F.size(passages).cast("string"), F.lit(" matching passage(s) in your documents:\n\n"), body, F.lit(FOOTER))
    return F.when(F.size(passages) == 0, NO_CONTEXT).otherwise(whole)


class Called:
    """Calls ``fn(question, [(path, text), ...]) -> str`` for each question, on the executors, several at a time in each task.

    A call that fails is repeated ``attempts`` times in all, after pauses that double; a task starts ``per_second`` calls at most.
    A question whose calls all fail has an empty text and an ``error``, and the others their answers. A task that is run again
    calls again: see :class:`Remembered`.
    """

    def __init__(self, fn: Callable[[str, list[tuple[str, str]]], str], name: str = "called", workers: int = 4, attempts: int = 3, pause: float = 1.0, per_second: float = 20.0):
        self.fn, self.name = fn, name
        self.workers, self.attempts, self.pause, self.per_second = workers, attempts, pause, per_second

    def answer(self, asked: DataFrame) -> DataFrame:
        fn, workers, attempts, pause, per_second = self.fn, self.workers, self.attempts, self.pause, self.per_second

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lock, free = threading.Lock(), [0.0]

            def wait() -> None:
                with lock:
                    start = max(free[0], time.monotonic())
                    free[0] = start + 1 / per_second
                time.sleep(max(0.0, start - time.monotonic()))

            def one(row: dict) -> tuple[str, str | None]:
                error = None
                for k in range(attempts):
                    if k:
                        time.sleep(pause * 2 ** (k - 1))
                    wait()
                    try:
                        return fn(row["question"], [(p["path"], p["text"]) for p in row["passages"] or ()]), None
                    except Exception as e:  # noqa: BLE001  a question without an answer is a row, not the end of the run
                        error = f"{type(e).__name__}: {e}"
                return "", error

            with ThreadPoolExecutor(workers) as pool:
                for batch in batches:
                    for part in (batch.slice(i, CALLED_ROWS) for i in range(0, batch.num_rows, CALLED_ROWS)):
                        made = list(pool.map(one, part.select(["question", "passages"]).to_pylist()))
                        texts, errors = (pa.array([m[k] for m in made], pa.string()) for k in (0, 1))
                        yield part.append_column("text", texts).append_column("error", errors)

        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
        return asked.mapInArrow(run, f"{ddl}, text string, error string")


class Remembered:
    """A generator whose answers are kept in a table: a prompt is asked once, whatever asks for it, in this run or a later one.

    ``path`` holds Parquet rows ``prompt_hash, text, error``; answers with an error are asked again. Runs that overlap may ask the
    same twice, and then the answer that sorts first counts for both.
    """

    def __init__(self, generator: Generator, path: str):
        self.generator, self.path, self.name = generator, path, generator.name

    def _kept(self, spark: SparkSession) -> DataFrame:
        try:
            rows = spark.read.schema("prompt_hash string, text string, error string").parquet(self.path)
        except AnalysisException as e:  # nothing has been kept yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], "prompt_hash string, text string, error string")
        good = F.min(F.when(F.col("error").isNull(), F.col("text")))
        return rows.groupBy("prompt_hash").agg(good.alias("text"), F.when(good.isNull(), F.max("error")).alias("error"))

    def answer(self, asked: DataFrame) -> DataFrame:
        spark = asked.sparkSession
        keyed = written(asked.withColumn("prompt_hash", F.sha2(F.to_json(F.struct(F.lit(self.name).alias("name"), "question", "passages")), 256)), "prompts")
        known = self._kept(spark).where("error is null").select("prompt_hash")
        fresh = with_error(self.generator.answer(keyed.join(known, "prompt_hash", "left_anti").dropDuplicates(["prompt_hash"])))
        fresh.select("prompt_hash", "text", "error").write.mode("append").parquet(self.path)
        return keyed.join(self._kept(spark), "prompt_hash", "left").withColumn("text", F.coalesce("text", F.lit(""))).drop("prompt_hash")


def with_error(made: DataFrame) -> DataFrame:
    """What a generator has made, with an ``error`` that is null where it gives none."""
    return made if "error" in made.columns else made.withColumn("error", F.lit(None).cast("string"))


def prompt(question: str, passages: list[tuple[str, str]]) -> str:
    sources = "\n\n".join(f"[{i}] Source: {path}\n{text}" for i, (path, text) in enumerate(passages, 1))
    return f"Sources:\n\n{sources}\n\n\nQuestion: {question}"


def remote(url: str, key: str, model: str, max_tokens: int = 1000, timeout: float = 30.0, headers: dict[str, str] | None = None, **calls) -> Called:
    """A generator behind an HTTP messages endpoint: a POST with model, system, messages and max_tokens; text blocks are joined.

    An ``error`` in the reply is raised with its message; the HTTP status is not looked at otherwise. Without passages the answer
    is a fixed sentence, and nothing is sent. ``headers`` are sent beside the key, such as the version that a service asks for;
    ``calls`` are options of :class:`Called`.
    """

    def fn(question: str, passages: list[tuple[str, str]]) -> str:
        if not passages:
            return NO_CONTEXT
        body = {"model": model, "max_tokens": max_tokens, "system": SYSTEM, "messages": [{"role": "user", "content": prompt(question, passages)}]}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", "x-api-key": key, **(headers or {})})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                found = json.load(reply)
        except urllib.error.HTTPError as e:
            found = json.load(e)
        if found.get("error"):
            raise RuntimeError(found["error"].get("message", "the generator failed"))
        return "".join(b.get("text", "") for b in found.get("content", []) if b.get("type") == "text")

    return Called(fn, f"remote:{model}", **calls)


def generator_from_env(prefix: str = "FLORILEGE") -> Generator:
    """The remote generator if ``<prefix>_GENERATOR_URL`` and ``_KEY`` are set, else the extractive one.

    ``_MODEL`` overrides the model, and ``_HEADERS`` is a JSON object of further headers.
    """
    url, key, headers = (os.environ.get(f"{prefix}_GENERATOR_{x}") for x in ("URL", "KEY", "HEADERS"))
    return remote(url, key, os.environ.get(f"{prefix}_GENERATOR_MODEL") or "default", headers=json.loads(headers or "{}")) if url and key else Extractive()


def answer(chunks: DataFrame, questions: DataFrame, options: AnswerOptions = AnswerOptions(), generator: Generator | None = None, dim: int = DIM, keyword_index: Retriever | None = None) -> DataFrame:
    """One row per question of ``questions(query_id, text[, top_k])``: ``query_id, question, text, citations, confidence, answerable, error``.

    Confidence is the best cosine. Below the threshold the answer is a refusal with null citations, and neither keyword search
    nor generator sees the question. Cosines are computed once, for both confidence and ranking. A ``top_k`` of 0 or null takes
    that of the options; options with a ``top_k`` of 0 are the default ones altogether. ``keyword_index`` is a stored index of
    the same chunks; without it their terms are read.
    """
    options = AnswerOptions() if options.top_k == 0 else options
    own_k = F.when(F.coalesce("top_k", F.lit(0)) > 0, F.col("top_k")).otherwise(options.top_k) if "top_k" in questions.columns else F.lit(options.top_k)
    asked = questions.select("query_id", F.col("text").alias("question"), own_k.alias("k"))
    if "top_k" in questions.columns and questions.where("top_k < 0").limit(1).count():
        raise ValueError("top_k must not be negative")
    most = checked_top_k(asked.agg(F.max("k")).first()[0] or options.top_k)
    texts = asked.select("query_id", F.col("question").alias("text"))
    vectors = cosine_top_k(chunks, embed_texts(texts, "query_id", dim), scores.fetch_size(most))
    vectors = written(vectors, "nearest")  # a few rows a question, which both the confidence and the ranking are read from
    best = vectors.where("rank = 1").select("query_id", F.col("score").alias("confidence"))
    known = asked.join(best, "query_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    known = known.withColumn("answerable", F.col("confidence") >= F.lit(options.threshold))
    open_ = known.where("answerable").select("query_id", "k")
    fetch = F.greatest(F.lit(20), 4 * F.col("k"))
    keyword = (keyword_index or KeywordIndex(chunks)).search(texts.join(open_.select("query_id"), "query_id", "left_semi"), scores.fetch_size(most))
    rankings = [r.join(open_, "query_id").where(F.col("rank") <= fetch).select("query_id", "chunk_id", "rank") for r in (vectors, keyword)]
    fused = fuse(rankings, most).join(open_, "query_id").where(F.col("rank") <= F.col("k"))
    # k rows a question: the chunks, with their texts, are not moved to meet them
    late = among(chunks.select(F.col("id").alias("chunk_id"), F.col("document_path").alias("path"), F.col("text").alias("passage")), fused, "chunk_id")
    row = F.struct("rank", "chunk_id", "path", F.col("passage").alias("text"), "score")
    got = late.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("hits"))  # at most k rows of a question
    full = known.where("answerable").join(got, "query_id", "left").withColumn("hits", F.coalesce("hits", F.expr("cast(array() as array<struct<rank:int,chunk_id:string,path:string,text:string,score:double>>)")))
    passages = F.transform("hits", lambda h: F.struct(h["path"].alias("path"), h["text"].alias("text")))
    citations = F.transform("hits", lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["path"].alias("document_path"), snippet(h["text"], SNIPPET_BYTES).alias("snippet"), h["score"].alias("score")))
    full = full.select("query_id", "question", "confidence", "answerable", passages.alias("passages"), citations.alias("citations"))
    columns = ["query_id", "question", "text", "citations", "confidence", "answerable", "error"]
    answered = with_error((generator or Extractive()).answer(full)).select(*columns)
    refused = with_error(known.where("not answerable")).withColumn("text", F.lit(REFUSAL)).withColumn("citations", F.lit(None).cast(full.schema["citations"].dataType))
    return answered.unionByName(refused.select(*columns))
