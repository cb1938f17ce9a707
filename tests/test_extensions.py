import random

import pytest
from pyspark.sql import functions as F

from graphloop.graph import Graph
from graphloop.operators.algorithms import pagerank, triangle_counts
from graphloop.operators.algorithms.demos import Range, RingReader
from graphloop.operators.algorithms.learning import random_centres
from graphloop.operators.combine import combine_messages
from graphloop.plans import superstep
from graphloop.plans.imperative import ImperativeProgram, run_imperative
from graphloop.plans.rounds import ConcatWords, run_rounds
from graphloop.plans.superstep import Plan, VertexProgram, run_program
from graphloop.scratch import shared_dir
from graphloop.sources import file_splits, parse_records, read_blocks, read_splits, tables
from graphloop.sources.records import record_to_json


@pytest.mark.parametrize(
    ("record", "json"),
    [
        ('{"a":{"b":1}}', '{"a":{"b":1}}'), ('{"s":"a 3d {{ model }}, 5f","e":{{1i64,2i8}}}', '{"s":"a 3d {{ model }}, 5f","e":[1,2]}'), ('{"a":{{{"k":{{}}}}}}', '{"a":[{"k":[]}]}'),
        ('{"t":datetime("2013-01-01T00:00:00"),"p":point("1.5,-2"),"n":null,"d":-3.5d,"i":int64("7"),"q":"\\"}"}', '{"t":"2013-01-01T00:00:00","p":{"x": 1.5, "y": -2.0},"n":null,"d":-3.5,"i":7,"q":"\\"}"}'),
    ],
)
def test_record_text(record, json):
    assert record_to_json(record) == json


@pytest.mark.parametrize("record", ['{"a":1', "{{1}", '{"a":[1}}', '{"a":1}]', "}", '{"a":{{1]}}'])
def test_unbalanced_records_raise(spark, record):
    with pytest.raises(ValueError, match="close"):
        record_to_json(record)
    with pytest.raises(Exception, match="MALFORMED"):
        parse_records(spark.createDataFrame([(record,)], "value string"), "a int").collect()


def test_file_splits_and_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.bin").write_bytes(bytes(range(250)) * 10)
    got = file_splits(f"n1:{tmp_path}/a.txt?k=v&w=, hdfs://host/p ,")
    assert [(s.node, s.options) for s in got] == [("n1", {"k": "v", "w": ""}), (None, {})] and got[1].path == "hdfs://host/p"
    rows = read_splits(spark, f"n1:{tmp_path}/a.txt?k=v,{tmp_path}/a.txt").collect()
    assert sorted((r["value"], r["options"].get("k", "")) for r in rows) == [("one", ""), ("one", "v"), ("two", ""), ("two", "v")]
    blocks = sorted((r["start"], bytes(r["block"])) for r in read_blocks(spark, f"{tmp_path}/b.bin", 999).collect())
    assert [s for s, _ in blocks] == [0, 999, 1998] and b"".join(b for _, b in blocks) == bytes(range(250)) * 10


def test_readers_models_and_files(spark, tmp_path):
    g = tables.read_vertices(spark, RingReader(25), 4)
    assert sorted(r["id"] for r in g.vertices.collect()) == list(range(25)) and g.edges.count() == 25
    words = spark.createDataFrame([("b",), ("a",)], "word string")
    model, _ = run_rounds(words, ConcatWords(), "", snapshot=tables.snapshot_models(spark, str(tmp_path / "m")))
    assert tables.load_model(spark, str(tmp_path / "m")) == (1, model) and tables.load_model(spark, str(tmp_path / "m"), 0) == (0, "")
    (tmp_path / "f.txt").write_text("sent")
    where = tables.spread_file(spark, str(tmp_path / "f.txt"))

    def read(batches):
        for rows in batches:
            rows["text"] = open(where()).read()
            yield rows

    assert {r["text"] for r in spark.range(3).mapInPandas(read, "id bigint, text string").collect()} == {"sent"}


def test_a_hub_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(superstep, "SPLIT", 50)
    rng = random.Random(1)
    edges = [(0, k) for k in range(1, 1001)] + [(rng.randint(1, 999), rng.randint(0, 999)) for _ in range(2000)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint").withColumn("value", F.lit(None).cast("double"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        dealt, _ = superstep._deal(df.select("src", "dst", F.col("value").alias("edge_value")))
        assert max(r["count"] for r in dealt.groupBy("src", "salt").count().collect()) < 150
        sizes = sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 3000 and sizes[-1] < 3 * sizes[len(sizes) // 2]
        dealt.unpersist()
        ranks = {r["id"]: r["value"] for r in pagerank(Graph.from_edges(df), 3).vertices.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    n = len(ranks)
    out = {}
    for s, d in edges:
        out.setdefault(s, []).append(d)
    want = dict.fromkeys(ranks, 1 / n)
    for _ in range(2):
        got = dict.fromkeys(ranks, 0.0)
        for s, ds in out.items():
            for d in ds:
                got[d] += want[s] / len(ds)
        want = {i: 0.15 / n + 0.85 * x for i, x in got.items()}
    assert all(abs(ranks[i] - want[i]) < 1e-12 for i in ranks)


class Spread(VertexProgram):
    """The range of the identifiers that point to a vertex, by a combiner of a user."""

    combine = Range()

    def __init__(self):
        self.seen = []

    def compute(self, ctx):
        return {"value": F.col("msg")}

    def sends(self, ctx):
        return F.lit(ctx.superstep == 1)

    def message(self, ctx):
        return F.col("id").cast("double")

    def before_superstep(self, ctx):
        self.seen.append(("before", ctx.superstep))

    def end_superstep(self, ctx, aggregates):
        self.seen.append(("end", ctx.superstep))


@pytest.mark.parametrize("plan", [Plan.FULL_SCAN, Plan.FRONTIER])
def test_user_combiner_and_hooks(spark, plan):
    edges = spark.createDataFrame([(1, 9), (5, 9), (7, 9), (7, 8)], "src bigint, dst bigint")
    program = Spread()
    got = {r["id"]: r["value"] for r in run_program(Graph.from_edges(edges), program, plan=plan).vertices.collect()}
    assert got[9] == 6.0 and got[8] == 0.0 and program.seen == [("before", 1), ("end", 1), ("before", 2), ("end", 2)]
    messages = edges.select(F.col("dst"), F.col("src").cast("double").alias("msg"))
    assert {tuple(r) for r in combine_messages(messages, Range()).collect()} == {(9, 6.0), (8, 0.0)}
    assert combine_messages(messages.limit(0), Range()).count() == 0


def test_an_imperative_run_is_resumed(spark, tmp_path):
    class Count(ImperativeProgram):  # local, so that it travels with the tasks
        value_type = "bigint"

        def compute(self, vertex, messages):
            vertex.value = (vertex.value or 0) + 1
            if vertex.superstep == 4:
                vertex.vote_to_halt()

    g = Graph(spark.range(20).select("id"), spark.createDataFrame([], "src bigint, dst bigint, value double"))
    run_imperative(g, Count(), max_supersteps=2, run_dir=str(tmp_path / "run"))
    assert len(list((tmp_path / "run").glob("step-*"))) == 1  # earlier ones are deleted
    got = run_imperative(g, Count(), resume=str(tmp_path / "run"))
    assert {r["value"] for r in got.collect()} == {4}
    with pytest.raises(FileNotFoundError):
        run_imperative(g, Count(), resume=str(tmp_path / "none"))


def test_triangles_of_a_hub_equal_brute_force(spark):
    rng = random.Random(4)
    edges = {(0, k) for k in range(1, 60)} | {tuple(sorted(rng.sample(range(1, 60), 2))) for _ in range(150)} | {(9, 3)}
    got = {r["id"]: r["triangles"] for r in triangle_counts(Graph.from_edges(spark.createDataFrame(sorted(edges), "src bigint, dst bigint"))).collect()}
    up = {e for e in edges if e[0] < e[1]}
    want = dict.fromkeys(got, 0)
    for u, v in up:
        want[u] += sum((u, w) in up and (v, w) in up for w in range(v + 1, 60))
    assert got == want and sum(want.values()) > 100


def test_centres_do_not_depend_on_partitions(spark):
    points = spark.range(100).select("id", (F.col("id") * 1.5).alias("x"))
    assert random_centres(points, ["x"], 5, 3, "id") == random_centres(points.repartition(7, "x"), ["x"], 5, 3, "id")


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="share"):
        shared_dir(Session())


def test_files_by_a_partitioner(spark, tmp_path):
    from graphloop.sources import write_vertices

    rows = spark.range(12).select("id", F.lit("v").alias("value"))
    write_vertices(rows, str(tmp_path / "p"), partition_by=F.floor(F.col("id") / 4), partitions=3)
    files = [sorted(int(line.split("\t")[0]) for line in p.read_text().splitlines()) for p in sorted((tmp_path / "p").glob("part-*"))]
    assert files == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
