"""Global aggregates: counts of a graph, named counters, termination votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloop.graph import Graph


def global_aggregate(df: DataFrame, **what: Column) -> dict:
    """Named aggregates over all rows, partial in every task; one row reaches the driver."""
    return df.agg(*[v.alias(k) for k, v in what.items()]).first().asDict()


def graph_counts(graph: Graph) -> DataFrame:
    """One row: num_vertices and num_edges."""
    return graph.vertices.agg(F.count("*").alias("num_vertices")).crossJoin(graph.edges.agg(F.count("*").alias("num_edges")))  # one row each


def counters(df: DataFrame, group: str, name: str, by: Column | None = None) -> DataFrame:
    """(group, name, total): named counters, summed; ``by`` is the increment of a row (1 if none)."""
    return df.groupBy(F.col(group).alias("counter_group"), F.col(name).alias("counter")).agg(F.sum(F.lit(1).cast("long") if by is None else by).alias("total"))


def termination_vote(vertices: DataFrame, messages: DataFrame) -> bool:
    """Whether every vertex has voted to halt and no message is under way."""
    awake = vertices.filter(~F.col("halted")).limit(1).count()
    return not awake and messages.isEmpty()
