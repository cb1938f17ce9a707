"""PageRank. ``max_supersteps`` counts the first superstep, so ranks are updated ``max_supersteps - 1`` times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloop.graph import Graph
from graphloop.plans.superstep import Context, Plan, Result, VertexProgram, run_program

DAMPING = 0.85


class PageRank(VertexProgram):
    """Dangling mass isn't given back; vertices that messages create get a rank from their first message on."""

    def compute(self, ctx: Context) -> dict[str, Column]:
        if ctx.superstep == 1:
            return {"value": F.lit(1.0 / ctx.num_vertices)}
        return {"value": F.lit((1 - DAMPING) / ctx.num_vertices) + DAMPING * F.coalesce("msg", F.lit(0.0))}

    def sends(self, ctx: Context) -> Column:
        return F.lit(ctx.superstep < ctx.last)

    def message(self, ctx: Context) -> Column:
        return F.col("value") / F.col("out_degree")

    def halt(self, ctx: Context) -> Column:
        return F.lit(ctx.superstep >= ctx.last)

    def aggregates(self, ctx: Context) -> dict[str, Column]:
        return {"mass": F.sum("value")}


class PageRankStatus(PageRank):
    """The same with a struct as state: the rank and a text beside it."""

    state = {"value": "struct<rank:double,status:string>"}

    def compute(self, ctx: Context) -> dict[str, Column]:
        rank = super().compute(ctx)["value"]
        return {"value": F.struct(rank.alias("rank"), F.lit(f"superstep {ctx.superstep}").alias("status"))}

    def message(self, ctx: Context) -> Column:
        return F.col("value.rank") / F.col("out_degree")

    def aggregates(self, ctx: Context) -> dict[str, Column]:
        return {"mass": F.sum("value.rank")}


def pagerank(graph: Graph, max_supersteps: int = 10, plan: Plan = Plan.FULL_SCAN, **options) -> Result:
    return run_program(graph, PageRank(), max_supersteps, plan, **options)


def pagerank_with_status(graph: Graph, max_supersteps: int = 10, **options) -> Result:
    return run_program(graph, PageRankStatus(), max_supersteps, Plan.FULL_SCAN, **options)
