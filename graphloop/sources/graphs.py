"""Graph sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloop.graph import Graph


def read_adjacency_text(spark: SparkSession, path: str | list[str]) -> Graph:
    """Lines of ``id dst dst ...`` between white space; an id alone is an isolated vertex, a blank line nothing.

    ``path`` can be a file, a folder, a pattern or a list; compressed text is read as well.
    """
    words = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    rows = spark.read.text(path).select(F.transform(words, lambda x: x.cast("bigint")).alias("w")).filter(F.size("w") > 0)
    return Graph.from_adjacency(rows.select(F.col("w")[0].alias("id"), F.slice("w", F.lit(2), F.size("w")).alias("targets")))


def ring(spark: SparkSession, n: int, value_step: float = 10.0, weight_step: float = 100.0) -> Graph:
    """n vertices, each with an edge to the next; value ``value_step * id``, weight ``weight_step * id``."""
    ids = spark.range(n)
    return Graph(ids.select("id", (F.col("id") * F.lit(value_step)).alias("value")), ids.select(F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(n)).alias("dst"), (F.col("id") * F.lit(weight_step)).alias("value")))


def range_vertices(spark: SparkSession, start: int = -2048, end: int = 2048, value: str = "aaa") -> Graph:
    """Vertices without edges, each with the same text."""
    return Graph(spark.range(start, end).withColumn("value", F.lit(value)), spark.createDataFrame([], "src bigint, dst bigint, value double"))


def replicate(graph: Graph, copies: int, offset: int | None = None) -> Graph:
    """``copies`` disjoint copies; identifiers of copy k rise by k times ``offset`` (the greatest identifier and 1)."""
    if offset is None:
        ends = graph.vertices.select("id").union(graph.edges.select("dst"))
        offset = (ends.agg(F.max("id")).first()[0] or 0) + 1
    k = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_k")
    by: Column = F.col("_k").cast("bigint") * F.lit(offset)
    vertices = graph.vertices.select("*", k).withColumn("id", F.col("id") + by).drop("_k")
    edges = graph.edges.select("*", k).withColumns({"src": F.col("src") + by, "dst": F.col("dst") + by}).drop("_k")
    return Graph(vertices, edges)


def write_vertices(vertices: DataFrame, path: str, fmt: str = "text", single: bool = False, sort: bool = True, compression: str | None = None, mode: str = "errorifexists", partition_by: Column | None = None, partitions: int | None = None) -> None:
    """Writes (id, value ...): ``id<TAB>value`` lines, or parquet, json, csv; sorted by id within files, or in one file.

    partition_by: rows of one value of it are in one file; with ``partitions``, the value is the number of the file.
    """
    out = vertices.repartitionByRange(1, "id") if single else vertices
    if partition_by is not None and partitions:
        # repartitionById sends a row to the partition of the number given.
        out = vertices.repartitionById(partitions, F.pmod(partition_by, F.lit(partitions)).cast("int"))
    elif partition_by is not None:
        out = vertices.repartition(partition_by)
    out = out.sortWithinPartitions("id") if sort else out
    if fmt == "text":
        out = out.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in out.columns]).alias("value"))
    writer = out.write.mode(mode)
    (writer.option("compression", compression) if compression else writer).format(fmt).save(path)


def balance_lines(lines: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """Text lines dealt evenly over n partitions, in random order with a seed."""
    return lines.repartition(n) if seed is None else lines.orderBy(F.rand(seed)).coalesce(n)


def sort_lines(lines: DataFrame) -> DataFrame:
    """Text lines in the order of the number that each begins with."""
    return lines.orderBy(F.regexp_extract("value", r"^\s*(-?\d+)", 1).try_cast("bigint"), "value")


def drop_field(lines: DataFrame, k: int) -> DataFrame:
    """Text lines without their k-th field (from 0), fields between white space."""
    w = F.split(F.trim("value"), r"\s+")
    return lines.select(F.array_join(F.filter(w, lambda x, i: i != k), " ").alias("value"))
