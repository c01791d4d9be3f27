"""Folders as tables: scan, choice of parser, hashes and text."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import RDD
from pyspark.serializers import NoOpSerializer, PairDeserializer, UTF8Deserializer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florilege.functions.text import blank_markdown, extension
from florilege.sources.folders import BROADCAST_IDS, BROADCAST_ROWS, written
from florilege.sources.pdf import OcrEngine, image_text, pdf_text

#: Extensions that each parser claims, with regard to case but for images.
MARKDOWN = [".md", ".markdown"]
PDF = [".pdf"]
CODE = [".go", ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".c", ".h", ".cpp", ".hpp", ".rs", ".rb", ".php", ".cs", ".sh", ".sql", ".yaml", ".yml", ".json", ".toml", ".proto"]
TEXT = [".txt"]
#: Parsers that work on bytes in Python.
BINARY_PARSERS = ["pdf", "image"]
#: Entries that a task lists at a time, and levels of folders that are listed one by one at most.
LISTED_ROWS, LEVELS = 10_000, 4
#: Files of a store that are opened one by one.
FEW_FILES = 10_000
_LOCAL = re.compile("^file:/*")
IMAGE = [".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp"]


def parser_of(path: Column, ocr: bool = False) -> Column:
    """The first parser that claims a path: markdown, pdf, code, text or (with OCR) image; null if none does."""
    ext = extension(path)
    out = F.when(ext.isin(MARKDOWN), "markdown").when(ext.isin(PDF), "pdf").when(ext.isin(CODE), "code").when(ext.isin(TEXT), "text")
    return out.when(F.lower(ext).isin(IMAGE), "image") if ocr else out


def _entry(path: str, link: bool = False) -> tuple[str, int, int]:
    """Path, time of the last change in microseconds and length; of a link that leads nowhere, those of the link."""
    try:
        found = os.lstat(path) if link else os.stat(path)
    except OSError:
        found = os.lstat(path)
    return path, found.st_mtime_ns // 1000, found.st_size


def _walk(folder: str, deep: bool) -> Iterator[tuple[str, int, int, bool]]:
    """Entries of a folder, or of all below it; links to folders count as files, and a folder that cannot be listed is an error."""

    def fail(error: OSError) -> None:
        raise error

    for at, inner, names in os.walk(folder, onerror=fail, followlinks=False):
        links = [d for d in inner if os.path.islink(os.path.join(at, d))]
        yield from ((*_entry(os.path.join(at, n), n in links), False) for n in [*names, *links])
        if not deep:
            yield from ((os.path.join(at, d), 0, 0, True) for d in inner if d not in links)
            return


def _listed(folders: DataFrame, deep: bool) -> DataFrame:
    """``path, modified, length, folder`` of what is in ``folders(path)``, listed by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = _walk(folder, deep)
                while rows := list(islice(found, LISTED_ROWS)):
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "modified", "length", "folder"])

    return folders.select("path").mapInArrow(run, "path string, modified long, length long, folder boolean")


def scan_folder(spark: SparkSession, root: str, stage: Callable[[DataFrame, str], DataFrame] = written, files_per_task: int = 256) -> DataFrame:
    """``path, modified, length`` of every file under a root that the driver and executors see, dot files too.

    Links to folders are not followed, not even as the root; a root that is a file gives that file. A folder that cannot be
    listed fails the scan, so that nothing is pruned by mistake. Executors list the folders, level by level until there are as
    many as tasks, and then each subtree as a whole; ``stage`` keeps each level and the result. The driver sees counts alone.
    """
    if not os.path.lexists(root):
        raise FileNotFoundError(root)
    kind = "path string, modified long, length long"
    if not os.path.isdir(root) or os.path.islink(root):
        return spark.createDataFrame([_entry(root)], kind)
    tasks = 2 * spark.sparkContext.defaultParallelism
    level = stage(_listed(spark.createDataFrame([(root,)], "path string"), False), "listing")
    files, folders = level.where("not folder"), level.where("folder")
    for _ in range(LEVELS):
        if not 0 < (n := folders.count()) < tasks:
            break
        level = stage(_listed(folders.repartition(n), False), "listing")
        files, folders = files.unionByName(level.where("not folder")), level.where("folder")
    if n := folders.count():
        files = files.unionByName(_listed(folders.repartition(min(n, 10 * tasks)), True))
    found = stage(files.drop("folder"), "files")
    return found.repartition(max(1, min(found.count() // files_per_task, 10_000)))


def read_files(paths: DataFrame) -> DataFrame:
    """The columns of ``paths(path, ...)`` with ``content`` and ``error`` of files on a path that executors see; an unreadable file has an error and no content."""
    names = paths.columns
    at = names.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column(at).to_pylist()):
                content = error = None
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except OSError as e:
                    error = f"{type(e).__name__}: {e.strerror}"
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], [*names, "content", "error"])

    return paths.mapInArrow(run, T.StructType([*paths.schema, T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]))


def hash_files(paths: DataFrame) -> DataFrame:
    """The columns of ``paths(path, ...)`` with ``hash`` and ``error``; contents are hashed piece by piece and go nowhere."""
    names = paths.columns
    at = names.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes: list[str | None] = []
            errors: list[str | None] = []
            for path in batch.column(at).to_pylist():
                try:
                    with open(path, "rb") as f:
                        hashes.append(hashlib.file_digest(f, "sha256").hexdigest())
                    errors.append(None)
                except OSError as e:
                    hashes.append(None)
                    errors.append(f"{type(e).__name__}: {e.strerror}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string()), pa.array(errors, pa.string())], [*names, "hash", "error"])

    return paths.mapInArrow(run, T.StructType([*paths.schema, T.StructField("hash", T.StringType()), T.StructField("error", T.StringType())]))


class Folder:
    """Files of a folder that the driver and the executors see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def paths(self, stage: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
        return scan_folder(self.spark, self.root, stage)

    def hashes(self, paths: DataFrame) -> DataFrame:
        return hash_files(paths)

    def read(self, paths: DataFrame) -> DataFrame:
        return read_files(paths)


class Files:
    """Files as a table ``path, content, error``."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def paths(self, stage: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
        return self.rows.select("path")

    def hashes(self, paths: DataFrame) -> DataFrame:
        return paths.join(self.rows.select("path", F.sha2("content", 256).alias("hash"), "error"), "path")

    def read(self, paths: DataFrame) -> DataFrame:
        """The files of ``paths``, which is counted: contents that are not asked for stay where they are, and none is sorted."""
        n, found = paths.count(), self.rows.select("path", "content", "error")
        if n <= BROADCAST_ROWS:
            return F.broadcast(paths).join(found, "path")
        if n <= BROADCAST_IDS:
            found = found.join(F.broadcast(paths.select("path")), "path", "left_semi")
        return paths.hint("shuffle_hash").join(found, "path")


def _store_listing(spark: SparkSession, root: str) -> dict[str, tuple]:
    """Hadoop path and length of every file under a root, or under what it matches as a pattern, by name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    tops = [where] if fs.exists(where) else [s.getPath() for s in fs.globStatus(where) or ()]
    if not tops:
        raise FileNotFoundError(root)
    out = {}
    for top in tops:
        found = fs.listFiles(top, True)
        while found.hasNext():
            status = found.next()
            out[status.getPath().toString()] = status.getPath(), status.getLen()
    return out


def _hidden(name: str) -> bool:
    """Whether Spark's readers leave out a folder of this name, unless it is a root."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _streams(spark: SparkSession, files: list[tuple], files_per_task: int = 256) -> DataFrame:
    """``path, content`` of Hadoop paths with lengths, whatever their names; the executors open them."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    hadoop, conf = jvm.org.apache.hadoop, jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    for prefix in ("mapreduce.", "yarn."):
        for key in list(conf.getPropsWithPrefix(prefix)):
            conf.unset(prefix + key)  # each stream carries the settings; those of file systems are enough
    context = hadoop.mapreduce.task.TaskAttemptContextImpl(conf, hadoop.mapreduce.TaskAttemptID())
    pairs = jvm.java.util.ArrayList()
    for path, length in files:
        paths, starts, lengths = new_array(hadoop.fs.Path, 1), new_array(jvm.long, 1), new_array(jvm.long, 1)
        paths[0], starts[0], lengths[0] = path, 0, length
        split = hadoop.mapreduce.lib.input.CombineFileSplit(paths, starts, lengths, new_array(jvm.String, 0))
        pairs.add(jvm.scala.Tuple2(path.toString(), jvm.org.apache.spark.input.PortableDataStream(split, context, 0)))
    rows = RDD(spark._jsc.parallelizePairs(pairs, max(1, len(files) // files_per_task)), spark.sparkContext, PairDeserializer(UTF8Deserializer(), NoOpSerializer()))
    return spark.createDataFrame(rows.map(lambda r: (r[0], bytearray(r[1]))), "path string, content binary")


def read_store_files(spark: SparkSession, root: str) -> DataFrame:
    """The same columns for every file under a root in any store that Spark reads; FileNotFoundError if there is none.

    Spark's reader leaves out files and folders whose names begin with a dot or underscore, and empty files. Such folders are
    given to it as roots, and the files that it still leaves out are opened as streams. Only names are gathered here.
    """
    listed = _store_listing(spark, root)
    load = lambda paths: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    found = load(root)
    left = listed.keys() - {r.path for r in found.select("path").toLocalIterator()}
    parents = {p[:i] for p in left for i in range(len(p)) if p[i] == "/"}
    base = spark._jvm.org.apache.hadoop.fs.Path(root).depth()
    folders = sorted(p for p in parents if _hidden(p.rpartition("/")[2]) and not set(p) & set("*?[]{}\\") and spark._jvm.org.apache.hadoop.fs.Path(p).depth() > base)
    if folders:
        found = found.unionByName(load(folders))
        left -= {r.path for r in found.select("path").toLocalIterator()}
    found = found.select("path", "content")
    if left:
        found = found.unionByName(_streams(spark, [listed[p] for p in sorted(left)]))
    return found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content", F.lit(None).cast("string").alias("error"))


class Store(Files):
    """Files under a root in any store that Spark reads; a few are opened one by one, without reading the others again."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(read_store_files(spark, root))
        self.spark, self.root = spark, root

    def read(self, paths: DataFrame) -> DataFrame:
        names = [r.path for r in paths.select("path").limit(FEW_FILES + 1).collect()]
        if len(names) > FEW_FILES:
            return super().read(paths)
        listed = {_LOCAL.sub("/", k): v for k, v in _store_listing(self.spark, self.root).items()}
        found = [listed[n] for n in sorted(set(names) & set(listed))]
        if not found:
            return paths.withColumns({"content": F.lit(None).cast("binary"), "error": F.lit("the file is gone")})
        contents = _streams(self.spark, found).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
        gone = F.when(F.col("content").isNull(), F.lit("the file is gone"))
        return paths.join(contents, "path", "left").withColumn("error", gone)


def parse(files: DataFrame, ocr: OcrEngine | None = None) -> DataFrame:
    """The columns of ``files(path, content, parser, ...)`` but ``content``, with ``text, boundaries, error``.

    Markdown, text and code are decoded in the JVM, invalid bytes becoming U+FFFD; PDFs and images go through Python.
    """
    binary = F.col("parser").isin(BINARY_PARSERS)
    return parse_text(files.where(~binary)).unionByName(parse_binary(files.where(binary), ocr))


def parse_text(files: DataFrame) -> DataFrame:
    """:func:`parse` for Markdown, text and code."""
    keep = [c for c in files.columns if c not in ("content", "error")]
    text = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.when(F.col("parser") == "markdown", blank_markdown(text)).otherwise(text)
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    return files.select(*keep, text.alias("text"), F.lit(None).cast("array<long>").alias("boundaries"), error.alias("error"))


def parse_binary(files: DataFrame, ocr: OcrEngine | None = None) -> DataFrame:
    """:func:`parse` for PDFs and images; a file that cannot be parsed has an error, and so has one that came with one."""
    keep = [c for c in files.columns if c not in ("content", "error")]
    given = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    at, n = {c: k for k, c in enumerate(keep)}, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, parser, content, error = (batch.column(i)[k].as_py() for i in (at["path"], at["parser"], n, n + 1))
                out, pages = None, None
                if error is None:
                    try:
                        out, pages = pdf_text(content, ocr) if parser == "pdf" else (image_text(content, os.path.splitext(path)[1], ocr), None)
                    except Exception as e:  # noqa: BLE001  a broken file is a row of the report, not the end of the run
                        error = f"{type(e).__name__}: {e}"
                made = [pa.array([out], pa.string()), pa.array([pages], pa.list_(pa.int64())), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns[:n], *made], [*keep, "text", "boundaries", "error"])

    more = [T.StructField("text", T.StringType()), T.StructField("boundaries", T.ArrayType(T.LongType())), T.StructField("error", T.StringType())]
    return files.select(*keep, "content", given.alias("error")).mapInArrow(run, T.StructType([*(files.schema[c] for c in keep), *more]))
