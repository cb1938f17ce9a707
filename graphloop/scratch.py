"""Tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own, and a cluster an error: a folder
    of one machine would lose rows there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share; the master is {master}")
        base = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="graphloop-")
        shared_dir.own = base
    return base


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet and reads it again with the same schema; ``release`` deletes it."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the table that ``materialise`` wrote for ``df``; nothing derived from it can be read afterwards."""
    path = getattr(df, "_scratch_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Deletes every scratch table in the shared folder, for the end of a session."""
    remove(spark, f"{shared_dir(spark)}/tables")
