import pytest
from simulator import min_label as sim_labels
from simulator import pagerank as sim_ranks
from simulator import webmap

from graphloop.graph import Graph
from graphloop.operators.algorithms import bidirectional_meet, connected_components, maximal_cliques, min_label, pagerank, pagerank_with_status, reachable, shortest_paths, triangle_counts, triangle_total
from graphloop.operators.algorithms.demos import CountMessages, EarlyTermination, Failing, GrowingText, Mutation
from graphloop.operators.algorithms.propagation import UNREACHED, ShortestPaths
from graphloop.operators.algorithms.sampling import sample_graph
from graphloop.plans.imperative import run_imperative
from graphloop.plans.pipeline import Job, run_pipeline
from graphloop.plans.superstep import Plan, VertexProgram, run_program
from graphloop.scratch import new_path

CLIQUE = {1: [2, 3, 4], 2: [1, 3, 4, 5], 3: [1, 2, 4, 5], 4: [1, 2, 3], 5: [6, 7], 6: [5, 7], 7: [5, 6]}
CLIQUE2 = {1: [2, 3, 4], 2: [1, 3], 3: [1, 2, 4, 5], 4: [1, 3], 5: [3, 6], 6: [5]}


def graph(spark, g):
    rows = spark.createDataFrame([(k, v) for k, v in g.items()], "id bigint, targets array<bigint>")
    return Graph.from_adjacency(rows)


def values(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize(("complex_", "n"), [(False, 20), (True, 23)])
def test_pagerank(spark, complex_, n):
    g = webmap(complex_)
    got = values(pagerank(graph(spark, g), 10, num_vertices=n).vertices)
    want = sim_ranks(g, n, 10)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert abs(got[0] - (0.0072088164890 if complex_ else 0.008290140026154316)) < 1e-9


def test_pagerank_with_status(spark):
    got = {r["id"]: r["value"] for r in pagerank_with_status(graph(spark, webmap()), 3).vertices.collect()}
    assert abs(got[1]["rank"] - sim_ranks(webmap(), 20, 3)[1]) < 1e-12 and got[1]["status"] == "superstep 3"


@pytest.mark.parametrize("plan", list(Plan))
def test_min_label(spark, plan):
    g = webmap(True)
    got = values(min_label(graph(spark, g), plan).vertices)
    assert got == sim_labels(g)
    assert (got[21], got[25], got[99], got[101], got[13]) == (21, 25, 1, 0, 0)


def test_components(spark):
    got = values(connected_components(graph(spark, {1: [2], 3: [2], 9: [8], 7: []})).vertices)
    assert {k: got[k] for k in (1, 2, 3, 7, 8, 9)} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 8, 9: 8}


@pytest.mark.parametrize("plan", [Plan.FULL_SCAN, Plan.FRONTIER])
def test_shortest_paths(spark, plan):
    got = values(shortest_paths(graph(spark, webmap()), 0, plan).vertices)
    assert got == {k: float(k) for k in range(20)}


def test_unreached_and_reachable(spark):
    g = graph(spark, {1: [2], 2: [3], 4: [1]})
    assert values(shortest_paths(g, 1).vertices)[4] == UNREACHED
    assert sorted(r[0] for r in reachable(g, 1).collect()) == [1, 2, 3]
    assert reachable(g, 1, 4).count() == 0 and reachable(g, 1, 3).count() == 1


def test_meet(spark):
    got = values(bidirectional_meet(graph(spark, webmap(True)), 1, 10).vertices)
    assert got == {10: 3} | dict.fromkeys(range(1, 10), 1) | dict.fromkeys([*range(11, 20), 99, 101], 2) | dict.fromkeys([0, 21, 25, 27], 0)
    apart = values(bidirectional_meet(graph(spark, webmap(True)), 1, 25).vertices)
    assert len(apart) == 26 and 3 not in apart.values()


def test_triangles(spark):
    assert values(triangle_counts(graph(spark, CLIQUE))) == {1: 3, 2: 2, 3: 0, 4: 0, 5: 1, 6: 0, 7: 0}
    assert triangle_total(graph(spark, CLIQUE)) == 6


def test_cliques(spark):
    assert values(maximal_cliques(graph(spark, CLIQUE2), prune_by=4)) == {1: "1,2,3;1,3,4;", 2: "2,3;", 3: "3,4;3,5;", 4: "", 5: "", 6: ""}
    assert values(maximal_cliques(graph(spark, CLIQUE2)))[5] == "5,6;"
    assert values(maximal_cliques(graph(spark, CLIQUE)))[1] == "1,2,3,4;"


def test_mutation(spark):
    got = values(run_imperative(graph(spark, webmap()), Mutation(), partitions=3))
    assert got == dict.fromkeys([1, 5, 7, 11, 13, 17, 19, 100, 500, 700, 1100, 1300, 1700], 0.0)


def test_early_termination(spark):
    got = values(run_imperative(graph(spark, webmap()), EarlyTermination(), partitions=4))
    assert {k: v or 0 for k, v in got.items()} == {k: {2: 0, 3: 1}.get(k % 4, 2) for k in range(20)}


def test_message_counts(spark):
    g = webmap()
    indegree = {k: sum(t.count(k) for t in g.values()) for k in g}
    assert values(run_program(graph(spark, g), CountMessages(), plan=Plan.FULL_SCAN).vertices) == {k: 10_000 * n for k, n in indegree.items()}


def test_growing_text_keeps_state(spark):
    got = values(run_imperative(graph(spark, {k: [] for k in range(-3, 3)}), GrowingText()))
    assert {k: len(v) for k, v in got.items()} == {k: 3 + (111 + k) % 100 for k in range(-3, 3)}


def test_failing_program_raises_at_once(spark):
    with pytest.raises(Exception, match="this vertex fails"):
        run_program(graph(spark, webmap()), Failing())


def test_null_message_raises(spark):
    class Null(ShortestPaths):
        def message(self, ctx):
            from pyspark.sql import functions as F

            return F.lit(None).cast("double")

    with pytest.raises(Exception, match="a message is null"):
        run_program(graph(spark, {1: [2]}), Null(1), plan=Plan.FULL_SCAN)


def test_resume_from_a_snapshot(spark):
    g, path, seen = graph(spark, webmap()), new_path(spark, "run"), []

    def break_off(ctx, _):
        if ctx.superstep == 5:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        pagerank(g, 10, run_dir=path, keep_every=2, on_superstep=break_off)
    rest = run_program(g, pagerank_program(), 10, Plan.FULL_SCAN, resume=path, on_superstep=lambda ctx, _: seen.append(ctx.superstep))
    want = sim_ranks(webmap(), 20, 10)
    assert seen == [5, 6, 7, 8, 9, 10] and all(abs(v - want[k]) < 1e-12 for k, v in values(rest.vertices).items())
    with pytest.raises(FileNotFoundError):
        run_program(g, pagerank_program(), 10, resume=new_path(spark, "none"))


def pagerank_program():
    from graphloop.operators.algorithms.rank import PageRank

    return PageRank()


def test_pipeline_carries_state(spark):
    g = graph(spark, webmap())
    one = values(run_pipeline(g, [Job(pagerank_program(), 10, Plan.FULL_SCAN)]).vertices)
    seen = []
    two = values(run_pipeline(g, [Job(pagerank_program(), 10, Plan.FULL_SCAN), Job(pagerank_program(), 10, Plan.FULL_SCAN)], lambda k, df: seen.append(df.count())).vertices)
    assert all(abs(one[k] - two[k]) < 1e-12 for k in one) and seen == [20, 20]


def test_isolated_and_empty(spark):
    assert values(shortest_paths(graph(spark, {5: []}), 5).vertices) == {5: 0.0}
    empty = Graph(spark.createDataFrame([], "id bigint"), spark.createDataFrame([], "src bigint, dst bigint, value double"))
    assert shortest_paths(empty, 1).vertices.count() == 0
    assert triangle_counts(empty).count() == 0


def test_sample_reaches_its_rate(spark):
    got = sample_graph(graph(spark, webmap()), 0.5, seed=3)
    assert got.vertices.count() >= 10
    ids = {r[0] for r in got.vertices.collect()}
    assert all(r["src"] in ids and r["dst"] in ids for r in got.edges.collect())


def test_base_program_is_abstract(spark):
    with pytest.raises(NotImplementedError):
        run_program(graph(spark, {1: []}), VertexProgram())
