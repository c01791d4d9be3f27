"""Tables written once to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows up to which a side of a join is broadcast, after a count; ids alone, of some 100 bytes each.
BROADCAST_ROWS, BROADCAST_IDS = 100_000, 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, on a local master alone, a folder of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="florilege-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/florilege/{label}-{uuid.uuid4().hex}"


def written(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written to a new folder and read back, so that all that follows sees the same rows, and makes none anew."""
    path = fresh_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def among(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with a table that is written first, and broadcast if its count allows: then ``rows`` stay where they are."""
    few = written(few, "few")
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, key)
