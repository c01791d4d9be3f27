"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset (tests, local mode) a folder of our own."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="florilege-"))
    return context.getCheckpointDir().rstrip("/")


#: Tables written in the innermost :func:`scratch` or :func:`tidy` of this thread.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def fresh_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    path = f"{shared_dir(spark)}/florilege/{label}-{uuid.uuid4().hex}"
    if not keep and (written := _written.get()) is not None:
        written.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving all tables that were written within, but for those that :func:`materialize` was told to keep."""
    written: list[str] = []
    before = _written.set(written)
    try:
        yield
    finally:
        _written.reset(before)
        for path in written:
            discard(spark, path)


def tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that deletes what it has written on the way, but for the tables that its result reads; those stay.

    Where it fails, all that it has written goes.
    """

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        written: list[str] = []
        before, read = _written.set(written), set()
        try:
            rows = query(spark, sf_dir)
            read = {file.rsplit("/florilege/", 1)[-1].split("/")[0] for file in rows.inputFiles()}
            return rows
        finally:
            _written.reset(before)
            for path in written:
                if path.rsplit("/", 1)[1] not in read:
                    discard(spark, path)

    return run


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, and survives the loss of executors.

    Adaptive execution fits the number of files to their size. ``keep`` holds the table beyond :func:`scratch`.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label, keep)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df_or_path: DataFrame | str) -> None:
    """Delete a table that :func:`materialize` wrote, once nothing reads it any more."""
    paths = [df_or_path] if isinstance(df_or_path, str) else sorted({f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()})
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        if "/florilege/" in path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
