"""A directed property graph: a vertex table keyed by ``id`` and an edge table ``(src, dst, value)``.

Edges are rows and not lists inside vertices, so a vertex with very many edges is spread over tasks. Self loops and parallel
edges are allowed and never dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame  # id BIGINT and state columns
    edges: DataFrame  # src BIGINT, dst BIGINT, value
    symmetric: bool = False  # whether every edge is there once each way

    @classmethod
    def from_edges(cls, edges: DataFrame) -> Graph:
        """The vertices are the end points of the edges."""
        e = edges if "value" in edges.columns else edges.withColumn("value", F.lit(None).cast("double"))
        ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return cls(ids, e.select("src", "dst", "value"))

    @classmethod
    def from_adjacency(cls, rows: DataFrame, ident: str = "id", targets: str = "targets") -> Graph:
        """rows: a vertex with the array of its targets; targets needn't be vertices themselves."""
        edges = rows.select(F.col(ident).alias("src"), F.explode(targets).alias("dst"), F.lit(None).cast("double").alias("value"))
        return cls(rows.select(F.col(ident).alias("id")), edges)

    def adjacency(self) -> DataFrame:
        """(id, edges): each vertex with its out-edges, sorted by target."""
        lists = self.edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "value"))).alias("edges"))
        empty = F.expr(f"cast(array() as {lists.schema['edges'].dataType.simpleString()})")
        return self.vertices.select("id").join(lists, F.col("id") == F.col("src"), "left").select("id", F.coalesce("edges", empty).alias("edges"))

    def out_degrees(self) -> DataFrame:
        """(id, degree) of vertices with an out-edge."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))

    def in_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))

    def counts(self) -> tuple[int, int]:
        return self.vertices.count(), self.edges.count()

    def undirected(self) -> Graph:
        """Every edge in both directions; an edge that is there both ways comes out once each way."""
        if self.symmetric:
            return self
        up = F.col("src") <= F.col("dst")
        low, high = F.when(up, F.col("src")).otherwise(F.col("dst")), F.when(up, F.col("dst")).otherwise(F.col("src"))
        once = self.edges.select(low.alias("low"), high.alias("high"), "value").groupBy("low", "high").agg(F.first("value").alias("value"))
        ends = F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array("low", "high"))
        both = once.withColumn("src", F.explode(ends)).select("src", F.when(F.col("src") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("dst"), "value")
        return replace(self, edges=both, symmetric=True)
