"""Helpers shared by the corpus operators: session preparation, scratch tables, column names."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloop.scratch import materialise, release, shared_dir

__all__ = ["ascii_lower", "materialise", "prepare", "release", "shared_dir", "table", "uniform"]
#: Rows per Arrow batch. Texts can be long, so a batch is kept small; this bounds a Python worker's memory.
BATCH_ROWS = 256
#: ASCII white space, the only separators of words in the contracts of several operators.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> SparkSession:
    """Makes this package importable by Python workers on this machine and keeps their memory and Arrow batches small.

    On a cluster the package is installed or passed by ``--py-files``; the extra path is then harmless.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    # Python workers give memory back, instead of keeping what their largest batch took.
    env.update({"MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "131072", "ARROW_DEFAULT_MEMORY_POOL": "system"})
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def uniform(c: Column) -> Column:
    """A number in [0, 1) from the MD5 digest of ``c`` as text; the same on every run, and in other SQL engines."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
