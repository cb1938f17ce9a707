"""Pipelines of graph jobs: state is carried over where a job's state columns match, with bounded retries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from graphloop.graph import Graph
from graphloop.plans.superstep import Plan, Result, VertexProgram, run_program


@dataclass(frozen=True)
class Job:
    program: VertexProgram
    max_supersteps: int = 2**31 - 1
    plan: Plan = Plan.AUTO
    reload: Callable[[], Graph] | None = None  # a graph of its own instead of the last job's


def run_pipeline(graph: Graph, jobs: list[Job], write: Callable[[int, DataFrame], None] | None = None, dealt: tuple[DataFrame, DataFrame] | None = None) -> Result:
    """Runs jobs one after the other; each starts at superstep 1, on the vertices and values of the one before.

    A job whose state has other names or types starts from the same vertices without values. ``dealt`` are the edges of
    ``graph`` from the function of that name, for jobs that don't load their own.
    """
    if not jobs:
        raise ValueError("a pipeline needs a job")
    result, before = None, None
    for k, job in enumerate(jobs):
        if job.reload:
            graph, dealt = job.reload(), None
        elif result is not None:
            carried = result.vertices if before == job.program.state else result.vertices.select("id")
            graph = Graph(carried, graph.edges)
        result, before = run_program(graph, job.program, job.max_supersteps, job.plan, dealt=dealt), job.program.state
        if write:
            write(k, result.vertices)
    return result
