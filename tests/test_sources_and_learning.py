import math

import pytest
from pyspark.sql import functions as F

from graphloop.functions import circle, intersects, milliseconds_between, point, switch_case
from graphloop.graph import Graph
from graphloop.operators import relational
from graphloop.operators.aggregates import global_aggregate, termination_vote
from graphloop.operators.algorithms import shortest_paths
from graphloop.operators.algorithms.learning import gradient_descent, kmeans, kmeans_restarts, random_centres
from graphloop.operators.combine import combine_messages, combiner
from graphloop.operators.mutate import add_edges, add_vertices, delete_vertices, remove_edges
from graphloop.plans.rounds import ConcatWords, SumAndCount, run_rounds
from graphloop.sources import parse_records, range_vertices, read_adjacency_text, read_delimited, read_labelled_sparse, replicate, ring, write_vertices
from graphloop.sources.graphs import balance_lines, drop_field, sort_lines

POINTS = [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (10.0, 10.0), (11.0, 11.0), (12.0, 12.0), (20.0, 20.0), (21.0, 21.0), (22.0, 22.0)]
START = [(1.0, 1.0), (10.0, 10.0), (20.0, 20.0)]


def test_adjacency_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 3\n\n2\t3\n  7 \n")
    g = read_adjacency_text(spark, str(tmp_path / "a.txt"))
    assert sorted(r[0] for r in g.vertices.collect()) == [1, 2, 7]
    assert sorted((r["src"], r["dst"]) for r in g.edges.collect()) == [(1, 2), (1, 3), (2, 3)]
    assert {r["id"]: len(r["edges"]) for r in g.adjacency().collect()} == {1: 2, 2: 1, 7: 0}


def test_ring_and_replicate(spark):
    got = {r["id"]: r["value"] for r in shortest_paths(ring(spark, 6), 0).vertices.collect()}
    assert got == {k: 100.0 * k * (k - 1) / 2 for k in range(6)}
    twice = replicate(ring(spark, 3), 2)
    assert sorted(r["id"] for r in twice.vertices.collect()) == list(range(6))
    assert sorted((r["src"], r["dst"]) for r in twice.edges.collect()) == [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)]
    assert range_vertices(spark).vertices.count() == 4096


def test_vertex_sink(spark, tmp_path):
    rows = spark.createDataFrame([(2, 0.5), (1, None)], "id bigint, value double")
    write_vertices(rows, str(tmp_path / "t"), single=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["1\tnull", "2\t0.5"]
    write_vertices(rows, str(tmp_path / "g"), compression="gzip")
    assert any(p.suffix == ".gz" for p in (tmp_path / "g").iterdir())


def test_lines(spark):
    lines = spark.createDataFrame([("10 a b",), ("9 c d",)], "value string")
    assert [r[0] for r in sort_lines(lines).collect()] == ["9 c d", "10 a b"]
    assert sorted(r[0] for r in drop_field(lines, 1).collect()) == ["10 b", "9 d"]
    assert balance_lines(lines, 3).count() == 2 and balance_lines(lines, 2, seed=1).count() == 2


def test_records_and_delimited(spark, tmp_path):
    lines = spark.createDataFrame([('{"id":5i64, "edges":{{1i64, 2i64}}}',), ("",)], "value string")
    assert [tuple(r) for r in parse_records(lines, "id bigint, edges array<bigint>").collect()] == [(5, [1, 2])]
    with pytest.raises(Exception, match="MALFORMED"):
        parse_records(spark.createDataFrame([('{"id":',)], "value string"), "id bigint").collect()
    (tmp_path / "c.tbl").write_text("1|x y|\n2||\n")
    assert [tuple(r) for r in read_delimited(spark, str(tmp_path / "c.tbl"), ["k", "v"]).collect()] == [("1", "x y"), ("2", None)]


def test_kmeans(spark):
    points = spark.createDataFrame(POINTS, "x double, y double")
    model = kmeans(points, ["x", "y"], START)
    assert model.centres == [(2.0, 2.0), (11.0, 11.0), (21.0, 21.0)] and model.rounds == 2
    assert math.isclose(model.distance_sum, 8.485281374238571)
    slow = kmeans(points, ["x", "y"], START, sequential_update=True)
    assert slow.centres == model.centres and slow.rounds == 4
    far = [*START, (900.0, 900.0)]
    assert kmeans(points, ["x", "y"], far).centres[3] == (900.0, 900.0)
    assert kmeans(points, ["x", "y"], far, rounds=1, keep_empty=False).centres[3] == (0.0, 0.0)
    assert len(set(random_centres(points, ["x", "y"], 3))) == 3
    assert kmeans_restarts(points, ["x", "y"], 3, restarts=5).distance_sum < 60


def test_gradient_descent(spark, tmp_path):
    (tmp_path / "d.txt").write_text("-1 0:0 1:0 2:0\n1 0:1,1=1 2:1\n")
    model = gradient_descent(read_labelled_sparse(spark, str(tmp_path / "d.txt")), 3)
    assert model.weights == [0.5, 0.5, 0.5] and model.error == 0 and model.rounds == 2


@pytest.mark.parametrize("topology", ["none", "generic", "nary"])
def test_imru_topologies_agree(spark, topology):
    words = spark.createDataFrame([(c,) for c in "fbdaec"], "word string").repartition(4)
    seen = []
    assert run_rounds(words, ConcatWords(), "", topology, snapshot=lambda n, m: seen.append((n, m))) == ("abcdef", 1)
    assert seen == [(0, ""), (1, "abcdef")]
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "key string, value double").repartition(3)
    assert run_rounds(rows, SumAndCount(), {}, topology, cache="none")[0] == {"a": (4.0, 2), "b": (2.0, 1)}


def test_imru_errors_propagate(spark):
    class Bad(SumAndCount):
        def reduce(self, parts):
            raise RuntimeError("bad reduce")

    with pytest.raises(RuntimeError, match="bad reduce"):
        run_rounds(spark.createDataFrame([("a", 1.0)], "key string, value double"), Bad(), {})
    with pytest.raises(ValueError, match="topology"):
        run_rounds(spark.createDataFrame([("a", 1.0)], "key string, value double"), SumAndCount(), {}, "ring")


def test_combiners(spark):
    m = spark.createDataFrame([(1, 5), (1, 2), (2, 4)], "dst bigint, msg bigint")
    get = lambda how: {r["dst"]: r["msg"] for r in combine_messages(m, how).collect()}
    assert get("sum") == {1: 7, 2: 4} and get("min") == {1: 2, 2: 4} and get("bit_or") == {1: 7, 2: 4} and get(F.max) == {1: 5, 2: 4}
    assert sorted(get("collect")[1]) == [2, 5]
    with pytest.raises(ValueError, match="no combiner"):
        combiner("median of medians")


def test_mutation_operators(spark):
    g = Graph(spark.createDataFrame([(1, 1.0), (2, 2.0)], "id bigint, value double"), spark.createDataFrame([(1, 2, 0.0), (1, 2, 0.0), (2, 1, 0.0)], "src bigint, dst bigint, value double"))
    new = spark.createDataFrame([(2, 9.0), (3, 3.0)], "id bigint, value double")
    ids = lambda g: {r["id"]: r["value"] for r in g.vertices.collect()}
    assert ids(add_vertices(g, new)) == {1: 1.0, 2: 9.0, 3: 3.0} and ids(add_vertices(g, new, "keep")) == {1: 1.0, 2: 2.0, 3: 3.0}
    with pytest.raises(ValueError, match="exists"):
        add_vertices(g, new, "error")
    assert delete_vertices(g, new).edges.count() == 2
    assert remove_edges(g, spark.createDataFrame([(1, 2)], "src bigint, dst bigint")).edges.count() == 1
    assert add_edges(g, spark.createDataFrame([(1, 2, 0.0)], "src bigint, dst bigint, value double")).edges.count() == 4


def test_functions(spark):
    row = spark.sql("SELECT timestamp_ntz'2020-01-01 00:00:00' AS a, timestamp_ntz'2020-01-01 00:00:01' AS b, 3.0D AS x, 4.0D AS y").select(
        milliseconds_between(F.col("a"), F.col("b")).alias("ms"),
        intersects(point(F.col("x"), F.col("y")), circle(point(F.lit(0), F.lit(0)), F.lit(5))).alias("edge"),
        intersects(point(F.col("x"), F.col("y")), circle(point(F.lit(0), F.lit(0)), F.lit(4.9))).alias("out"),
        switch_case(F.col("x"), F.lit(1), F.lit("one"), F.lit(3), F.lit("three")).alias("s"),
    ).first()
    assert tuple(row) == (1000, True, False, "three")


def test_relational(spark):
    a = spark.sql("SELECT id AS i, id % 2 AS k, timestamp_millis(id * 100) AS t FROM range(20)")
    b = a.select(F.col("i").alias("j"), "k", F.col("t").alias("u"))
    got = {(r["i"], r["j"]) for r in relational.time_distance_join(a, b, "k", "t", "u", 250).collect()}
    assert got == {(i, j) for i in range(20) for j in range(20) if i % 2 == j % 2 and abs(i - j) * 100 <= 250}
    assert [r["i"] for r in relational.top_k(a, 2, F.desc("i")).collect()] == [19, 18]
    assert relational.groups_of_at_least(a, "k", 10).count() == 2 and relational.find_largest(a, "i").first()[0] == 19
    assert global_aggregate(a, n=F.count("*"))["n"] == 20
    v = spark.createDataFrame([(1, True)], "id bigint, halted boolean")
    assert termination_vote(v, a.limit(0)) and not termination_vote(v, a)


def test_command_line(spark, tmp_path):
    from graphloop import cli

    (tmp_path / "in.txt").write_text("1 2\n2 3\n3\n")
    cli.main(["shortest-paths", str(tmp_path / "in.txt"), str(tmp_path / "out"), "--source", "1", "--single"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1\t0.0", "2\t1.0", "3\t2.0"]
    cli.main(["triangles", str(tmp_path / "in.txt"), str(tmp_path / "t"), "--format", "parquet"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_scratch_tables_can_be_released(spark):
    from graphloop.scratch import materialise, release

    df = materialise(spark.range(3), "test")
    assert df.count() == 3
    release(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(df._scratch_path).count()
