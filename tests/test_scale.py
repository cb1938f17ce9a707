"""What has to hold for large tables, on small ones: how often edges are moved and read, and what passes the driver."""

import os
import re

import pytest
from pyspark.sql import functions as F

from graphloop import queries as own
from graphloop.graph import Graph
from graphloop.operators.algorithms.propagation import MinLabel
from graphloop.plans import superstep
from graphloop.plans.superstep import Context, Plan, State

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan_of(df) -> str:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    text = text.split("== Initial Plan ==")[0]  # of the query itself; those of what it has cached come later
    return re.sub(r"InMemoryRelation.*?(?=\n +[|:] *[:+]-|\Z)", "", text, flags=re.S)


@pytest.fixture
def step(spark):
    """Dealt edges, and the vertices after a first superstep, of which all have sent."""
    edges = spark.range(3000).selectExpr("id % 97 AS src", "(id * 7919) % 503 AS dst", "cast(null as double) AS edge_value")
    dealt, _ = superstep._deal(edges)
    whole = spark.range(503).selectExpr("id", "id AS value", "cast(null as bigint) AS least", "true AS halted", "id < 97 AS sent", "if(id < 97, 31L, 0L) AS out_degree", "1 AS at")
    yield dealt, whole, Context(1, 503, 3000, 9), Context(2, 503, 3000, 9)
    superstep._free(dealt)


def test_a_superstep_neither_shuffles_nor_sorts_edges(step):
    dealt, whole, last, _ = step
    text = plan_of(superstep._messages(whole, dealt, MinLabel(), last))
    above = text.split("InMemoryTableScan")[0].split("SortMergeJoin")[1]  # between the join and the edges
    assert "Exchange" not in above and "Sort " not in above, text


@tables
def test_jobs_of_a_pipeline_share_dealt_edges(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(superstep, "_deal", lambda edges, f=superstep._deal: calls.append(1) or f(edges))
    assert own.QUERIES["job_pipeline"](spark, SF).count() and len(calls) == 1


def frontier(step, changed: bool):
    dealt, whole, last, ctx = step
    newer = whole.filter("id < 50") if changed else None
    return superstep._step(State(whole, "none", newer, "none" if changed else None), dealt, MinLabel(), ctx, last, Plan.FRONTIER, 0)


@pytest.mark.parametrize("changed", [False, True])
def test_a_frontier_step_sends_no_vertices_through_the_driver(step, changed):
    assert "Broadcast" not in plan_of(frontier(step, changed))


def test_a_frontier_step_reads_the_last_snapshot_once(step):
    text = frontier(step, True)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Range \(0, 503", text)) == 3  # the snapshot, and what has changed twice


@pytest.mark.parametrize("plan", list(Plan))
def test_vertices_that_messages_create_are_counted(spark, plan):
    edges = [(k, k + 1) for k in range(20)] + [(k, 100 + k) for k in range(20)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint").selectExpr("src", "dst", "cast(null as double) value")
    seen = []
    done = superstep.run_program(Graph(spark.range(20), df), own.PageRank(), 4, plan, on_superstep=lambda ctx, b: seen.append(b["n"]))
    assert seen == [20, 41, 41, 41] and done.vertices.count() == 41 and done.num_vertices == 20
    apart = []
    superstep.run_program(Graph(spark.range(20), df), own.MinLabel(), plan=plan, on_superstep=lambda ctx, b: apart.append(b["n"]))
    assert apart[0] == 20 and apart == sorted(apart)


def test_vertices_are_read_once_and_edges_twice(spark, tmp_path):
    def noted(df, name):
        at = str(tmp_path / name)

        def note(batches):
            n = 0
            for rows in batches:
                n += len(rows)
                yield rows
            with open(at, "a") as f:
                f.write(f"{n}\n")

        return df.mapInPandas(note, df.schema), lambda: sum(map(int, open(at)))

    edges = spark.range(300).selectExpr("id % 50 AS src", "(id * 7) % 50 AS dst", "cast(null as double) AS value")
    (v, vertices), (e, every) = noted(spark.range(50), "vertices"), noted(edges, "edges")
    superstep.run_program(Graph(v, e), own.PageRank(), 3, Plan.FULL_SCAN)
    assert (vertices(), every()) == (50, 600)  # edges for degrees, and to be dealt


@tables
def test_the_source_table_is_made_of_one_join(spark, monkeypatch):
    made = []
    monkeypatch.setattr(own.tables, "write_table", lambda rows, *a, f=own.tables.write_table, **b: made.append(rows) or f(rows, *a, **b))
    own.QUERIES["table_to_table"](spark, SF)
    assert not any("lineitem" in x for x in made[0].inputFiles())
    assert made[0].select(F.explode("edges.dst")).count() == own.next_part(spark, SF).edges.count()


@tables
def test_records_are_parsed_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(own, "LINES", 10)
    rows = own.QUERIES["record_text_nested"](spark, SF)
    assert rows.select(F.spark_partition_id()).distinct().count() >= 12  # 150 lines; the file is one task


@tables
@pytest.mark.parametrize("name", ["degree_out", "vertex_edge_counts"])
def test_pairs_of_a_task_are_bounded(spark, monkeypatch, name):
    monkeypatch.setattr(own, "ROWS", 500)
    pairs = own.supplier_part(spark, SF, both_ways=False).edges
    most = max(r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect())
    assert most < 500 and pairs.count() == pairs.distinct().count() > 1500
    assert "REPARTITION_BY_NUM" in plan_of(own.QUERIES[name](spark, SF))


@tables
@pytest.mark.parametrize("name", ["connected_components_frontier", "pagerank_struct_state", "pagerank_supplier_part", "top_suppliers_by_rank"])
def test_lines_are_read_once_for_a_run(spark, monkeypatch, name):
    """Pairs and vertices are kept; no program goes back to the lines."""
    seen = []
    monkeypatch.setattr(superstep, "_start", lambda graph, *rest, f=superstep._start: seen.append(graph) or f(graph, *rest))
    assert own.QUERIES[name](spark, SF).count()
    assert seen and not any("lineitem" in x for g in seen for df in (g.vertices, g.edges) for x in df.inputFiles())


@tables
@pytest.mark.parametrize("name", ["reachable_from_1", "min_label_parts", "table_to_table", "bfs_hops_from_1", "shortest_paths_from_1"])
def test_the_join_of_lines_is_made_once(spark, monkeypatch, name):
    seen = []
    monkeypatch.setattr(superstep, "_start", lambda graph, *rest, f=superstep._start: seen.append(graph) or f(graph, *rest))
    assert own.QUERIES[name](spark, SF).count()
    assert seen and not any("lineitem" in x for g in seen for x in g.edges.inputFiles())
