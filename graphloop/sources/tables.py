"""Graphs from tables and back, readers of any kind, generated data, tables by name, and files for every task."""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloop.graph import Graph
from graphloop.plans.superstep import Result, VertexProgram, run_program


class VertexReader(ABC):
    """A source of vertices that Spark has no reader for. ``read`` runs in the tasks, once for each split."""

    value_type = "double"

    @abstractmethod
    def splits(self, hint: int) -> list[Any]:
        """What is read apart; ``hint`` is how many tasks there are."""

    @abstractmethod
    def read(self, split: Any) -> Iterable[tuple[int, Any, list[tuple[int, float | None]]]]:
        """(id, value, [(target, edge value)]) of the split's vertices, one after the other."""


def read_vertices(spark: SparkSession, reader: VertexReader, hint: int | None = None) -> Graph:
    """The graph that ``reader`` gives; each split is a task, and vertices are streamed in batches."""
    splits = reader.splits(hint or spark.sparkContext.defaultParallelism)
    columns = ["id", "value", "edges"]

    def of(batch: list[tuple]) -> pd.DataFrame:
        rows = [(i, v, [{"dst": d, "value": x} for d, x in edges]) for i, v, edges in batch]
        return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(columns)})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for split in rows["split"]:
                held: list[tuple] = []
                for vertex in reader.read(pickle.loads(split)):
                    held.append(vertex)
                    if len(held) == 10_000:
                        yield of(held)
                        held = []
                yield of(held)

    schema = f"id bigint, value {reader.value_type}, edges array<struct<dst:bigint,value:double>>"
    rows = _of_splits(spark, splits).mapInPandas(read, schema)
    edges = rows.select(F.col("id").alias("src"), F.explode("edges").alias("e")).select("src", "e.dst", "e.value")
    return Graph(rows.select("id", "value"), edges)


def _of_splits(spark: SparkSession, splits: list[Any]) -> DataFrame:
    rows = spark.createDataFrame([(k, pickle.dumps(s)) for k, s in enumerate(splits)], "k int, split binary")
    return rows.repartitionByRange(max(1, len(splits)), "k").select("split")


def generate(spark: SparkSession, splits: list[Any], make: Callable[[Any], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of ``schema`` that ``make`` gives for each split, made in the tasks."""
    names = [f.split()[0] for f in schema.split(",")]

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for split in rows["split"]:
                yield pd.DataFrame(list(make(pickle.loads(split))), columns=names)

    return _of_splits(spark, splits).mapInPandas(made, schema)


def graph_from_table(rows: DataFrame, ident: str, targets: str | None = None, **state: Column | str) -> Graph:
    """A graph of a table's rows: a column with the identifier, one with an array of targets, and expressions of the state."""
    vertices = rows.select(F.col(ident).cast("bigint").alias("id"), *[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in state.items()])
    none = rows.sparkSession.createDataFrame([], "src bigint, dst bigint, value double")
    if targets is None:
        return Graph(vertices, none)
    edges = rows.select(F.col(ident).cast("bigint").alias("src"), F.explode(F.col(targets).cast("array<bigint>")).alias("dst"))
    return Graph(vertices, edges.withColumn("value", F.lit(None).cast("double")))


def write_table(vertices: DataFrame, name: str, key: str = "id", clean: bool = True, path: str | None = None, fmt: str = "parquet", **columns: Column | str) -> None:
    """Writes a table by name, dealt and sorted by ``key``; its rows are replaced (``clean``) or added to."""
    out = vertices.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()]) if columns else vertices
    dealt = out.repartition(F.col(key)).sortWithinPartitions(key)
    writer = dealt.write.format(fmt).mode("overwrite" if clean else "append")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def run_table_to_table(spark: SparkSession, source: str, target: str, program: VertexProgram, ident: str, targets: str, key: str, columns: dict[str, Column | str], path: str | None = None, state: dict[str, Column | str] | None = None, **options) -> Result:
    """Runs ``program`` on the table ``source`` and writes its vertices, as ``columns``, to the table ``target``."""
    result = run_program(graph_from_table(spark.table(source), ident, targets, **(state or {})), program, **options)
    write_table(result.vertices, target, key, path=path, **columns)
    return result


def create_table(spark: SparkSession, name: str, schema: str, path: str | None = None, exists_ok: bool = False) -> None:
    """An empty table of ``schema``; the database is made if it is new."""
    if "." in name:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name.rpartition('.')[0]}")
    if exists_ok and spark.catalog.tableExists(name):
        return
    writer = spark.createDataFrame([], schema).write.format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def insert(spark: SparkSession, name: str, rows: DataFrame, returning: list[str] | None = None) -> DataFrame:
    """Adds rows to a table, columns by name, and gives them back (or ``returning`` of them)."""
    rows.select(*spark.table(name).columns).write.insertInto(name)
    return rows.select(*returning) if returning else rows


def spread_file(spark: SparkSession, path: str) -> Callable[[], str]:
    """Sends a file to every executor; the function gives its place there, in a task as on the driver."""
    spark.sparkContext.addFile(path)
    name = path.rstrip("/").rpartition("/")[2]
    return lambda: SparkFiles.get(name)


def snapshot_models(spark: SparkSession, path: str) -> Callable[[int, Any], None]:
    """A callback for learning loops that keeps the model of every round in a table below ``path``."""

    def keep(n: int, model: Any) -> None:
        spark.createDataFrame([(n, pickle.dumps(model))], "n int, model binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/round-{n:06d}")

    return keep


def load_model(spark: SparkSession, path: str, n: int | None = None) -> tuple[int, Any]:
    """(round, model) from snapshots: of round ``n``, or of the last one."""
    kept = spark.read.parquet(f"{path}/round-*")
    row = kept.filter(F.col("n") == n).first() if n is not None else kept.orderBy(F.desc("n")).first()
    if row is None:
        raise FileNotFoundError(f"{path} has no model of round {n}")
    return row["n"], pickle.loads(row["model"])
