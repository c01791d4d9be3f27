"""Watching a folder: a processing-time stream whose batches compare snapshots.

A file source would not do: it never gives a path twice, so it misses edits, and it misses deletions. The rate source is only
the clock; each batch runs the incremental ingestion, which is idempotent, so a batch that is run again does no harm.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

DEFAULT_INTERVAL = 5.0
log = logging.getLogger(__name__)


def watch(spark: SparkSession, on_change: Callable[[], object], interval: float = DEFAULT_INTERVAL, checkpoint: str | None = None) -> StreamingQuery:
    """Call ``on_change`` once per interval, the first time after one, until the query is stopped; an interval of 0 or less means
    five seconds.

    An error is logged, and watching goes on.
    """
    seconds = interval if interval > 0 else DEFAULT_INTERVAL
    began = time.monotonic()

    def tick(batch: DataFrame, number: int) -> None:
        if time.monotonic() - began < seconds / 2:
            return  # the batch that a stream begins with
        try:
            on_change()
        except Exception:
            log.exception("ingestion %d failed", number)

    writer = spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(tick)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{seconds} seconds").start()
