"""Graph mutation between supersteps: vertices and edges are added and removed by key.

Deletes are applied before inserts, so a vertex that is removed and added in one superstep is the added one. An insert of an
identifier that exists replaces it (``replace``), keeps the old one (``keep``) or raises (``error``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloop.graph import Graph


def delete_vertices(graph: Graph, ids: DataFrame, edges_too: bool = True) -> Graph:
    """Removes vertices by ``id``, with the edges that leave them."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    vertices = graph.vertices.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    edges = graph.edges.join(gone, F.col("src") == F.col("_gone"), "left_anti") if edges_too else graph.edges
    return Graph(vertices, edges)


def add_vertices(graph: Graph, new: DataFrame, conflict: str = "replace") -> Graph:
    """Adds vertices; state columns that ``new`` lacks are null."""
    if conflict == "replace":
        kept = delete_vertices(graph, new, edges_too=False).vertices
    elif conflict == "keep":
        kept = graph.vertices
        new = new.join(kept.select(F.col("id").alias("_there")), F.col("id") == F.col("_there"), "left_anti")
    elif conflict == "error":
        kept = graph.vertices
        if not new.join(kept.select("id"), "id", "left_semi").isEmpty():
            raise ValueError("a vertex to be added exists already")
    else:
        raise ValueError(f"no conflict policy {conflict!r}")
    return Graph(kept.unionByName(new.dropDuplicates(["id"]), allowMissingColumns=True), graph.edges)


def add_edges(graph: Graph, new: DataFrame) -> Graph:
    """Adds edges; parallel ones are kept."""
    return Graph(graph.vertices, graph.edges.unionByName(new, allowMissingColumns=True))


def remove_edges(graph: Graph, gone: DataFrame) -> Graph:
    """Removes all edges with the (src, dst) of a row of ``gone``."""
    keys = gone.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    return Graph(graph.vertices, graph.edges.join(keys, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_anti"))
