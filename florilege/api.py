"""The engine: index folders, ask questions, watch, list and export."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from florilege.operators.chunk import DIM
from florilege.operators.fusion import hybrid_search
from florilege.operators.ingest import IngestResult, ingest
from florilege.plans.answer import Generator, answer, generator_from_env
from florilege.plans.export import listing_line, session_markdown
from florilege.schema import QUESTIONS, AnswerOptions, ChunkOptions
from florilege.sources.files import Folder, Store
from florilege.sources.pdf import OcrEngine
from florilege.sources.store import Collection, CollectionStore, collection_id
from florilege.streaming.watch import DEFAULT_INTERVAL, watch


class Engine:
    """Collections under a base path. Loaded ones are kept, cached by id, until anyone saves them anew."""

    def __init__(self, spark: SparkSession, base: str, chunking: ChunkOptions = ChunkOptions(), answers: AnswerOptions = AnswerOptions(), dim: int = DIM, ocr: OcrEngine | None = None, generator: Generator | None = None):
        self.spark, self.store = spark, CollectionStore(spark, base)
        self.chunking, self.answers, self.dim, self.ocr = chunking, answers, dim, ocr
        self.generator = generator or generator_from_env()
        self._loaded: dict[str, Collection] = {}

    @property
    def ocr_available(self) -> bool:
        return self.ocr is not None

    def load(self, name: str) -> Collection:
        """The collection in force; it is read anew if anyone has saved it since it was last asked for."""
        cid = collection_id(name)
        old = self._loaded.get(cid)
        if old is None or old.version != self.store.version(cid):
            self._forget(cid)
            found = self.store.load(cid)
            found.chunks = found.chunks.persist()
            self._loaded[cid] = found
        return self._loaded[cid]

    def _forget(self, cid: str) -> None:
        if old := self._loaded.pop(cid, None):
            old.chunks.unpersist()

    def index(self, root: str, name: str, prune_root_only: bool = False) -> IngestResult:
        """Bring a collection up to date with a folder and save it if anything changed, deletions too.

        An existing collection keeps its first root path. All or nothing: an error leaves the saved version as it was.
        """
        cid = collection_id(name)
        known = self.store.exists(cid)
        now = self.store.load(cid) if known else Collection.new(self.spark, name, root)
        source = Store(self.spark, root) if "://" in root else Folder(self.spark, root)
        try:
            result = ingest(now, source, self.chunking, self.dim, self.ocr, root if prune_root_only else None, lambda rows, label: self.store.staging(cid, label, rows))
            result.report = result.report.persist()  # paths and words, read now, while the staged tables are there
            changed = result.report.where(F.col("status").isin("added", "updated", "removed")).limit(1).count()
            result.report.count()
            if changed or not known:
                result.collection = self.store.append(cid, result.delta) if known else self.store.save(result.collection)
                self._forget(cid)
            else:
                result.collection = now
        finally:
            self.store.clear()
        return result

    def questions(self, texts: Iterable[str], top_k: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(i, t, top_k) for i, t in enumerate(texts, 1)], QUESTIONS)

    def search(self, questions: DataFrame, name: str, top_k: int = 0) -> DataFrame:
        found = self.load(name)
        return hybrid_search(found.chunks, questions, top_k, self.dim, found.index)

    def ask(self, question: str | DataFrame, name: str, top_k: int = 0) -> DataFrame:
        """Answers to one question or to a table of them; FileNotFoundError for an unknown collection."""
        if top_k < 0:
            raise ValueError("top_k must not be negative")
        asked = self.questions([question], top_k) if isinstance(question, str) else question
        found = self.load(name)
        return answer(found.chunks, asked, self.answers, self.generator, self.dim, found.index).withColumn("backend", F.lit(self.generator.name))

    def watch(self, root: str, name: str, interval: float = DEFAULT_INTERVAL) -> StreamingQuery:
        """Index once, then again at every interval."""
        self.index(root, name)
        return watch(self.spark, lambda: self.index(root, name), interval)

    def list_collections(self) -> DataFrame:
        """``id, name, root_path, doc_count, chunk_count, line``; unreadable collections are left out."""
        out = self.store.summaries()
        return out.withColumn("line", listing_line(F.col("name"), F.col("doc_count"), F.col("chunk_count"), F.col("root_path")))

    def export_session(self, answers: DataFrame, name: str) -> str:
        """Markdown of answers, in the order of their query ids."""
        now = datetime.now(timezone.utc).isoformat(timespec="seconds")
        return session_markdown(answers.withColumn("seq", F.col("query_id")), name, now)
