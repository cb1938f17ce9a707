"""Runs a graph program over adjacency text: ``python -m graphloop.cli pagerank INPUT OUTPUT --plan auto``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from graphloop.operators.algorithms import bidirectional_meet, connected_components, maximal_cliques, min_label, pagerank, reachable, shortest_paths, triangle_counts
from graphloop.operators.algorithms.sampling import sample_graph
from graphloop.plans.superstep import Plan
from graphloop.sources import read_adjacency_text, write_vertices
from graphloop.sources.tables import graph_from_table, write_table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloop", description=__doc__)
    p.add_argument("job", choices=["pagerank", "min-label", "components", "shortest-paths", "meet", "reachable", "triangles", "cliques", "sample"])
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--plan", choices=[x.value for x in Plan], default=Plan.AUTO.value, help="how a superstep joins messages with vertices")
    p.add_argument("--num-vertices", type=int, help="what programs see as the number of vertices")
    p.add_argument("--max-supersteps", type=int, help="at most so many supersteps, the first included")
    p.add_argument("--source", type=int, default=1)
    p.add_argument("--target", type=int, default=10)
    p.add_argument("--rate", type=float, default=0.1, help="share of vertices to sample")
    p.add_argument("--keep-every", type=int, default=0, help="keep a snapshot every so many supersteps")
    p.add_argument("--run-dir", help="folder of the snapshots")
    p.add_argument("--resume", help="go on from the last snapshot in this folder")
    p.add_argument("--format", default="text", choices=["text", "parquet", "json", "csv"])
    p.add_argument("--tables", action="store_true", help="INPUT and OUTPUT are tables; OUTPUT's rows are replaced")
    p.add_argument("--id-column", default="vertexid", help="of INPUT's identifier, and of OUTPUT's")
    p.add_argument("--targets-column", default="edgelist", help="of INPUT's array of targets")
    p.add_argument("--single", action="store_true", help="one output file, sorted by identifier")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    graph = graph_from_table(spark.table(args.input), args.id_column, args.targets_column) if args.tables else read_adjacency_text(spark, args.input)
    plan = Plan(args.plan)
    options = {"num_vertices": args.num_vertices, "keep_every": args.keep_every, "run_dir": args.run_dir, "resume": args.resume}
    most = args.max_supersteps or 2**31 - 1
    if args.job == "pagerank":
        return pagerank(graph, args.max_supersteps or 10, plan, **options).vertices
    if args.job == "min-label":
        return min_label(graph, plan, most, **options).vertices
    if args.job == "components":
        return connected_components(graph, plan, max_supersteps=most, **options).vertices
    if args.job == "shortest-paths":
        return shortest_paths(graph, args.source, plan, max_supersteps=most, **options).vertices
    if args.job == "meet":
        return bidirectional_meet(graph, args.source, args.target, plan, max_supersteps=most, **options).vertices
    if args.job == "reachable":
        return reachable(graph, args.source)
    if args.job == "triangles":
        return triangle_counts(graph)
    if args.job == "cliques":
        return maximal_cliques(graph)
    return sample_graph(graph, args.rate).vertices


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"graphloop {args.job}").getOrCreate()
    out = run(spark, args)
    if args.tables:
        write_table(out.withColumnRenamed("id", args.id_column), args.output, args.id_column)
    else:
        write_vertices(out, args.output, args.format, single=args.single)


if __name__ == "__main__":
    main()
