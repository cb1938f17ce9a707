"""Graph sampling by seeded random walks until a share of the vertices is selected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloop.graph import Graph
from graphloop.plans.superstep import Context, Plan, Result, VertexProgram, run_program


class Sample(VertexProgram):
    """Every superstep selects some seeds and passes a mark along about half of a newly selected vertex's edges."""

    state = {"value": "boolean"}
    message_type, combine = "boolean", "bool_or"

    def __init__(self, rate: float, seed: int = 0):
        self.rate, self.seed = rate, seed

    def _u(self, ctx: Context, *what: Column | str) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(ctx.superstep), *what), F.lit(1_000_000)) / 1_000_000

    def _full(self, ctx: Context) -> bool:
        return ctx.superstep > 1 and (ctx.aggregates.get("selected") or 0) >= self.rate * ctx.num_vertices

    def compute(self, ctx: Context) -> dict[str, Column]:
        seeds = F.lit(False) if self._full(ctx) else self._u(ctx, "id") < F.lit(self.rate / 10)
        return {"value": F.coalesce("value", F.lit(False)) | F.col("msg").isNotNull() | seeds}

    def sends(self, ctx: Context) -> Column:
        return F.col("value") & ~F.coalesce("old_value", F.lit(False)) & F.lit(not self._full(ctx))

    def send_along(self, ctx: Context) -> Column | None:
        return self._u(ctx, "id", "dst") < 0.5

    def message(self, ctx: Context) -> Column:
        return F.lit(True)

    def halt(self, ctx: Context) -> Column:
        return F.lit(self._full(ctx))

    def aggregates(self, ctx: Context) -> dict[str, Column]:
        return {"selected": F.sum(F.col("value").cast("long"))}


def sample_graph(graph: Graph, rate: float, seed: int = 0) -> Graph:
    """The selected vertices (at least ``rate`` of all) and the edges between them."""
    result: Result = run_program(graph, Sample(rate, seed), 10_000, Plan.FULL_SCAN)
    chosen = result.vertices.filter("value").select("id")
    edges = graph.edges.join(chosen.withColumnRenamed("id", "src"), "src", "left_semi").join(chosen.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(chosen, edges.select("src", "dst", "value"))
