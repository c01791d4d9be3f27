"""Configuration of the jobs: one JSON object, read by Spark, so that it may lie in any store."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def load(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults, with what the file says instead; a ValueError names keys that no default has, and values of another type."""
    if path is None:
        return dict(defaults)
    given = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if unknown := sorted(given.keys() - defaults.keys()):
        raise ValueError(f"{path}: unknown keys {unknown}")
    for key, value in given.items():
        if type(value) is not type(defaults[key]) and not (isinstance(defaults[key], float) and isinstance(value, int)):
            raise ValueError(f"{path}: {key} must be like {defaults[key]!r}")
    return {**defaults, **given}
