"""The registered queries of the graph and learning operators, over the whole test tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloop.functions import circle, intersects, point, switch_case
from graphloop.graph import Graph
from graphloop.operators import relational
from graphloop.operators.aggregates import counters, graph_counts
from graphloop.operators.algorithms import bfs_hops, bidirectional_meet, connected_components, maximal_cliques, min_label, pagerank, pagerank_with_status, reachable, shortest_paths, triangle_counts
from graphloop.operators.algorithms.demos import ColumnMutation, CountMessages, EarlyTermination, GrowingText, Mutation, Range, Rewire, RingReader, squares_from
from graphloop.operators.algorithms.learning import assign, gradient_descent, kmeans, kmeans_restarts
from graphloop.operators.algorithms.propagation import UNREACHED, MinLabel
from graphloop.operators.algorithms.rank import PageRank
from graphloop.operators.algorithms.sampling import sample_graph
from graphloop.operators.combine import combine_messages
from graphloop.operators.mutate import add_edges, add_vertices, delete_vertices, remove_edges
from graphloop.plans.imperative import run_imperative
from graphloop.plans.rounds import SumAndCount, as_rows, run_rounds
from graphloop.plans.pipeline import Job, run_pipeline
from graphloop.plans.superstep import Plan, dealt, run_program
from graphloop.scratch import materialise, new_path
from graphloop.sources import parse_records, read_adjacency_text, read_delimited, replicate, ring, tables, write_vertices

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PART = 1_000_000_000
ROWS, LINES = 1_000_000, 50_000


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tasks(df: DataFrame, rows: int | None = None) -> int:
    """Over how many tasks rows are dealt: ``ROWS`` each, so that a task's work and memory don't grow with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (rows or ROWS)))


def supplier_part(spark: SparkSession, sf: str, both_ways: bool = True, keep: bool = False) -> Graph:
    """Suppliers and the parts they have shipped (identifiers from ``PART`` on), in both directions or from suppliers only.

    ``keep`` writes the pairs and the vertices to scratch tables, for programs that read them again and again.
    """
    lines = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART).alias("dst"))
    pairs = lines.repartition(_tasks(lines), "src", "dst").distinct()
    pairs = materialise(pairs, "pairs") if keep else pairs
    ids = pairs.select(F.col("src").alias("id")).distinct().union(pairs.select("dst").distinct()).distinct()
    edges = pairs.union(pairs.select("dst", "src")) if both_ways else pairs
    return Graph(materialise(ids, "ids") if keep else ids, edges.withColumn("value", F.lit(None).cast("double")), symmetric=both_ways)


def next_part(spark: SparkSession, sf: str) -> Graph:
    """Parts, with an edge to each part on the next line of an order; the value is the least quantity there. Edges are kept."""
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    later = lines.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("q"))
    pairs = lines.join(later, (F.col("l_orderkey") == F.col("o")) & (F.col("l_linenumber") == F.col("n"))).groupBy(F.col("l_partkey").alias("src"), "dst").agg(F.min("q").alias("value"))
    return Graph(_t(spark, sf, "part").select(F.col("p_partkey").alias("id")), materialise(pairs, "next"))


def bought_together(spark: SparkSession, sf: str) -> Graph:
    """Parts of one order, both ways."""
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey").filter("l_orderkey is not null")
    orders = lines.repartition(_tasks(lines), "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    pairs = orders.select("parts", F.explode("parts").alias("src")).select("src", F.explode("parts").alias("dst")).filter("src <> dst").distinct()
    return Graph(_t(spark, sf, "part").select(F.col("p_partkey").alias("id")), pairs.withColumn("value", F.lit(None).cast("double")))


ONE_WAY = f"pairs AS (SELECT DISTINCT l_suppkey AS src, l_partkey + {PART} AS dst FROM lineitem)"
BOTH = f"{ONE_WAY}, edges AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs), verts AS (SELECT DISTINCT src AS id FROM edges)"
NEXT = "edges AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, min(b.l_quantity) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY ALL), verts AS (SELECT p_partkey AS id FROM part)"
TOGETHER = "edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey)"


def _ranks(rounds: int) -> str:
    out = [f"deg AS (SELECT src, count(*) AS d FROM edges GROUP BY src), n AS (SELECT count(*) AS n FROM verts), r1 AS (SELECT id, 1.0::DOUBLE / n AS v FROM verts, n)"]  # noqa: F541
    for k in range(2, rounds + 1):
        out.append(f"m{k} AS (SELECT dst, sum(v / d) AS m FROM r{k - 1} JOIN edges ON id = edges.src JOIN deg ON deg.src = id GROUP BY dst), r{k} AS (SELECT id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(m, 0) AS v FROM verts CROSS JOIN n LEFT JOIN m{k} ON dst = id)")
    return ", ".join(out)


#: To the fixpoint: what comes later takes the place of an earlier row of its key.
LABELS = """l(id, v) USING KEY (id) AS (
  SELECT id, least(id, coalesce(m, id)) FROM verts LEFT JOIN (SELECT src, min(dst) AS m FROM edges GROUP BY src) ON src = id UNION
  SELECT e.dst, min(l.v) FROM l JOIN edges e ON e.src = l.id JOIN recurring.l r ON r.id = e.dst WHERE r.v > l.v AND l.v < l.id GROUP BY e.dst
)"""


def _distances(weight: str, source: int = 1) -> str:
    return f"""d(id, v) USING KEY (id) AS (
  SELECT id, 0.0::DOUBLE FROM verts WHERE id = {source} UNION
  SELECT e.dst, min(d.v + {weight}) FROM d JOIN edges e ON e.src = d.id LEFT JOIN recurring.d r ON r.id = e.dst WHERE r.v IS NULL OR r.v > d.v + {weight} GROUP BY e.dst
)"""


# Graphs, degrees, counts


@query(f"WITH {BOTH} SELECT src AS id, count(*) AS degree FROM edges GROUP BY src")
def degree_out(spark, sf):
    return supplier_part(spark, sf).out_degrees()


@query(f"WITH {ONE_WAY} SELECT dst AS id, count(*) AS degree FROM pairs GROUP BY dst")
def degree_in(spark, sf):
    return supplier_part(spark, sf, both_ways=False).in_degrees()


@query(f"WITH {BOTH} SELECT (SELECT count(*) FROM verts) AS num_vertices, (SELECT count(*) FROM edges) AS num_edges")
def vertex_edge_counts(spark, sf):
    return graph_counts(supplier_part(spark, sf))


@query("SELECT 'events' AS counter_group, event_type AS counter, CAST(count(*) AS BIGINT) AS total FROM events GROUP BY event_type")
def named_counters(spark, sf):
    return counters(_t(spark, sf, "events").withColumn("g", F.lit("events")), "g", "event_type")


@query("SELECT n_regionkey * 1 + k * 25 AS src, n_nationkey + k * 25 AS dst FROM nation, range(4) AS r(k)")
def replicate_x4(spark, sf):
    nations = _t(spark, sf, "nation").select(F.col("n_regionkey").cast("bigint").alias("src"), F.col("n_nationkey").cast("bigint").alias("dst"))
    return replicate(Graph.from_edges(nations), 4, 25).edges.select("src", "dst")


# Ranks


@query(f"WITH {BOTH}, {_ranks(10)} SELECT id, round(v * n, 6) AS rank FROM r10, n")
def pagerank_supplier_part(spark, sf):
    done = pagerank(supplier_part(spark, sf, keep=True), 10)
    return done.vertices.select("id", F.round(F.col("value") * done.num_vertices, 6).alias("rank"))


@query(f"WITH {BOTH}, {_ranks(4)} SELECT id, round(v * n, 6) AS rank, 'superstep 4' AS status FROM r4, n")
def pagerank_struct_state(spark, sf):
    done = pagerank_with_status(supplier_part(spark, sf, keep=True), 4)
    return done.vertices.select("id", F.round(F.col("value.rank") * done.num_vertices, 6).alias("rank"), F.col("value.status").alias("status"))


@query(f"WITH {BOTH}, {_ranks(10)} SELECT s_suppkey, s_name, round(v * n, 6) AS rank FROM r10 JOIN supplier ON s_suppkey = id CROSS JOIN n ORDER BY rank DESC, s_suppkey LIMIT 50")
def top_suppliers_by_rank(spark, sf):
    """The 50 suppliers of the highest rank: a graph job between a relational load and a relational query."""
    ranked = pagerank_supplier_part(spark, sf)
    named = _t(spark, sf, "supplier").join(ranked, F.col("s_suppkey") == F.col("id"))
    return relational.top_k(named.select("s_suppkey", "s_name", "rank"), 50, F.desc("rank"), "s_suppkey")


# Labels, distances, reachability


@query(f"WITH RECURSIVE {NEXT}, {LABELS} SELECT id, v AS value FROM l")
def min_label_parts(spark, sf):
    return min_label(next_part(spark, sf)).vertices


@query(f"WITH RECURSIVE {BOTH}, {LABELS} SELECT id, v AS value FROM l")
def connected_components_full_scan(spark, sf):
    return connected_components(supplier_part(spark, sf, keep=True), Plan.FULL_SCAN).vertices


@query(f"WITH RECURSIVE {BOTH}, {LABELS} SELECT id, v AS value FROM l")
def connected_components_frontier(spark, sf):
    return connected_components(supplier_part(spark, sf, keep=True), Plan.FRONTIER).vertices


@query(f"WITH RECURSIVE {NEXT}, {_distances('e.w')} SELECT id, v AS value FROM d")
def shortest_paths_from_1(spark, sf):
    """To the fixpoint, with no bound on hops."""
    return shortest_paths(next_part(spark, sf), 1).vertices.filter(F.col("value") < UNREACHED)


@query("SELECT k AS id, 50.0::DOUBLE * (k * (k - 1)) AS value FROM range(40) AS r(k)")
def shortest_paths_ring(spark, sf):
    return shortest_paths(ring(spark, 40), 0).vertices


@query(f"WITH RECURSIVE {NEXT}, {_distances('1.0')} SELECT id, CAST(v AS BIGINT) AS hops FROM d")
def bfs_hops_from_1(spark, sf):
    """To the fixpoint, with no bound on hops."""
    return bfs_hops(next_part(spark, sf), 1)


@query(f"WITH RECURSIVE {NEXT}, {_distances('1.0')} SELECT id FROM d")
def reachable_from_1(spark, sf):
    return reachable(next_part(spark, sf), 1)


def _meet(rounds: int) -> str:
    out = ["s1 AS (SELECT id, CASE id WHEN 2 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS v FROM verts)"]
    for k in range(2, rounds + 1):
        out.append(f"s{k} AS (SELECT s.id, CASE WHEN (SELECT max(v) FROM s{k - 1}) = 3 THEN s.v ELSE s.v | coalesce(m, 0) END AS v FROM s{k - 1} s LEFT JOIN (SELECT dst, bit_or(v) AS m FROM s{k - 1} JOIN edges ON src = id WHERE v IN (1, 2) GROUP BY dst) ON dst = s.id)")
    return ", ".join(out)


@query(f"WITH {NEXT}, {_meet(8)} SELECT id, CAST(v AS INTEGER) AS value FROM s8")
def meet_1_and_2(spark, sf):
    return bidirectional_meet(next_part(spark, sf), 1, 2).vertices.select("id", F.col("value").cast("int").alias("value"))


# Structure


@query(f"WITH {TOGETHER} SELECT p_partkey AS id, coalesce(n, 0) AS triangles FROM part LEFT JOIN (SELECT a.src AS u, count(*) AS n FROM edges a JOIN edges b ON a.dst = b.src AND a.src < a.dst AND b.src < b.dst JOIN edges c ON c.src = a.src AND c.dst = b.dst GROUP BY a.src) ON u = p_partkey")
def triangles_bought_together(spark, sf):
    return triangle_counts(bought_together(spark, sf))


@query()
def cliques_bought_together(spark, sf):
    return maximal_cliques(bought_together(spark, sf))


@query(f"WITH {ONE_WAY} SELECT id, CAST(coalesce(n, 0) * 10000 AS BIGINT) AS value FROM (SELECT src AS id FROM pairs UNION SELECT dst FROM pairs) LEFT JOIN (SELECT dst, count(*) AS n FROM pairs GROUP BY dst) ON dst = id")
def message_counts(spark, sf):
    return run_program(supplier_part(spark, sf, both_ways=False, keep=True), CountMessages(), plan=Plan.FULL_SCAN).vertices


# Mutation and imperative programs


def _customers(spark, sf) -> Graph:
    return Graph(_t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(0.0).alias("value")), spark.createDataFrame([], "src bigint, dst bigint, value double"))


MUTATED = "SELECT DISTINCT id, 0.0::DOUBLE AS value FROM (SELECT c_custkey AS id FROM customer WHERE NOT (c_custkey < 100 AND (c_custkey % 2 = 0 OR c_custkey % 3 = 0)) UNION SELECT 100 * c_custkey FROM customer WHERE c_custkey < 100 AND c_custkey % 2 <> 0 AND c_custkey % 3 <> 0) WHERE id <> 1900"


@query(MUTATED)
def graph_mutation(spark, sf):
    return run_imperative(_customers(spark, sf), Mutation())


@query(MUTATED)
def graph_mutation_by_columns(spark, sf):
    """The same by a column program: vertices that delete themselves, add others and write to them."""
    return run_program(_customers(spark, sf), ColumnMutation()).vertices


@query(f"WITH {ONE_WAY}, own AS (SELECT src AS id FROM pairs UNION SELECT dst FROM pairs), now AS (SELECT src, dst FROM pairs WHERE dst % 2 = 1 UNION ALL SELECT id, id FROM own) SELECT dst AS id, CAST(count(*) AS BIGINT) AS value FROM now GROUP BY dst")
def edge_mutation_by_columns(spark, sf):
    """Vertices drop their edges to even identifiers, add one to themselves, and count what then reaches them."""
    return run_program(supplier_part(spark, sf, both_ways=False, keep=True), Rewire()).vertices


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END::BIGINT AS value FROM customer")
def early_termination(spark, sf):
    return run_imperative(_customers(spark, sf), EarlyTermination(), partitions=4)


@query("SELECT c_custkey AS id, repeat('a', CAST(3 + (111 + c_custkey) % 100 AS INTEGER)) AS value FROM customer")
def growing_state(spark, sf):
    g = _customers(spark, sf)
    return run_imperative(Graph(g.vertices.select("id"), g.edges), GrowingText())


@query(f"WITH {ONE_WAY} SELECT src, dst FROM pairs WHERE src % 7 <> 0 AND src NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT n_nationkey, n_regionkey FROM nation")
def mutate_edges(spark, sf):
    g = supplier_part(spark, sf, both_ways=False)
    nations = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("dst"))
    g = remove_edges(g, g.edges.filter("src % 7 = 0"))
    g = add_edges(add_vertices(delete_vertices(g, nations), nations.select("id")), nations.select(F.col("id").alias("src"), "dst"))
    return g.edges.select("src", "dst")


@query(f"WITH RECURSIVE {BOTH}, {LABELS} SELECT id, v AS value FROM l")
def job_pipeline(spark, sf):
    """PageRank, then components on the vertices that it leaves."""
    g = supplier_part(spark, sf, keep=True)
    with dealt(g) as own:
        ranked = run_pipeline(g, [Job(PageRank(), 3, Plan.FULL_SCAN), Job(PageRank(), 3, Plan.FULL_SCAN)], dealt=own)
        return connected_components(replace(g, vertices=ranked.vertices.select("id")), dealt=own).vertices


# Combiners


@query("SELECT l_partkey AS dst, sum(l_quantity) AS msg FROM lineitem GROUP BY l_partkey")
def combine_sum(spark, sf):
    return combine_messages(_messages(spark, sf, "l_quantity"), "sum")


@query("SELECT l_partkey AS dst, min(l_quantity) AS msg FROM lineitem GROUP BY l_partkey")
def combine_min(spark, sf):
    return combine_messages(_messages(spark, sf, "l_quantity"), "min")


@query("SELECT l_partkey AS dst, max(l_quantity) AS msg FROM lineitem GROUP BY l_partkey")
def combine_max(spark, sf):
    return combine_messages(_messages(spark, sf, "l_quantity"), "max")


@query("SELECT l_partkey AS dst, bit_or(l_linenumber) AS msg FROM lineitem GROUP BY l_partkey")
def combine_bit_or(spark, sf):
    return combine_messages(_messages(spark, sf, "l_linenumber"), "bit_or")


@query("SELECT l_partkey AS dst, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS msg FROM lineitem GROUP BY l_partkey")
def combine_collect(spark, sf):
    return combine_messages(_messages(spark, sf, "l_linenumber"), "collect").select("dst", F.array_join(F.sort_array("msg"), ",").alias("msg"))


@query("SELECT l_partkey AS dst, CAST(max(l_quantity) - min(l_quantity) AS DOUBLE) AS msg FROM lineitem GROUP BY l_partkey")
def combine_by_user(spark, sf):
    """A combiner of three phases that a user writes: the range of the messages."""
    return combine_messages(_messages(spark, sf, "l_quantity"), Range())


def _messages(spark, sf, column: str) -> DataFrame:
    return _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("dst"), F.col(column).alias("msg"))


# Relational operators


def _join(spark, sf, how: str, hint: str | None = None) -> DataFrame:
    customers, orders = _t(spark, sf, "customer").select("c_custkey", "c_name"), _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return relational.key_join(customers, orders, F.col("c_custkey") == F.col("o_custkey"), how, hint).select("c_custkey", "c_name", "o_orderkey")


_JOIN = "SELECT c_custkey, c_name, o_orderkey FROM customer {} JOIN orders ON c_custkey = o_custkey"


@query(_JOIN.format("INNER"))
def join_inner(spark, sf):
    return _join(spark, sf, "inner", "merge")


@query(_JOIN.format("INNER"))
def join_inner_hash(spark, sf):
    return _join(spark, sf, "inner", "shuffle_hash")


@query(_JOIN.format("LEFT"))
def join_left_outer(spark, sf):
    return _join(spark, sf, "left_outer")


@query(_JOIN.format("RIGHT"))
def join_right_outer(spark, sf):
    return _join(spark, sf, "right_outer")


@query(_JOIN.format("FULL"))
def join_full_outer(spark, sf):
    return _join(spark, sf, "full_outer")


@query("SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders")
def key_union(spark, sf):
    return relational.key_union(_t(spark, sf, "customer").select(F.col("c_custkey").alias("k")), _t(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT a.user_id AS user_id, count(*) AS n_pairs FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_ms(a.ts) - epoch_ms(b.ts)) <= 86400000 GROUP BY a.user_id")
def interval_self_join(spark, sf):
    """Pairs of events of one user within a day."""
    e = _t(spark, sf, "events").select("event_id", "user_id", "ts")
    other = e.select(F.col("event_id").alias("event2"), "user_id", F.col("ts").alias("ts2"))
    return relational.time_distance_join(e, other, "user_id", "ts", "ts2", 86_400_000).filter("event_id < event2").groupBy("user_id").agg(F.count("*").alias("n_pairs"))


@query("SELECT vec_id FROM embeddings WHERE embedding[1]::DOUBLE * embedding[1]::DOUBLE + embedding[2]::DOUBLE * embedding[2]::DOUBLE <= 0.01::DOUBLE * 0.01::DOUBLE * 4")
def spatial_circle(spark, sf):
    p = point(F.col("embedding")[0], F.col("embedding")[1])
    return _t(spark, sf, "embeddings").filter(intersects(p, circle(point(F.lit(0.0), F.lit(0.0)), F.lit(0.02)))).select("vec_id")


@query("SELECT user_id, round(sum(value), 4) AS score FROM events GROUP BY user_id ORDER BY score DESC, user_id LIMIT 50")
def top_users(spark, sf):
    return relational.top_k(_t(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("score")), 50, F.desc("score"), "user_id")


@query("SELECT c_custkey AS vertexid, 1.0::DOUBLE / (SELECT count(*) FROM customer) AS value FROM customer")
def initial_ranks(spark, sf):
    """A scalar subquery and a division."""
    customers = _t(spark, sf, "customer").select(F.col("c_custkey").alias("vertexid"))
    return customers.crossJoin(customers.agg(F.count("*").alias("n"))).select("vertexid", (F.lit(1.0) / F.col("n")).alias("value"))  # the right side is one row


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 2.0::DOUBLE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS weight FROM events")
def switch_weights(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.coalesce(switch_case(F.col("event_type"), F.lit("purchase"), F.lit(2.0), F.lit("click"), F.lit(1.0)), F.lit(0.0)).alias("weight"))


@query("SELECT max(o_orderkey) AS largest FROM orders")
def find_largest(spark, sf):
    return relational.find_largest(_t(spark, sf, "orders"), "o_orderkey")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) >= 5")
def common_source(spark, sf):
    return relational.groups_of_at_least(_t(spark, sf, "lineitem"), "l_partkey", 5)


# Sources and sinks


@query(f"WITH {ONE_WAY} SELECT src, dst FROM pairs")
def adjacency_text_round_trip(spark, sf):
    lists = supplier_part(spark, sf, both_ways=False).adjacency()
    lines = lists.select(F.concat_ws(" ", F.col("id").cast("string"), F.array_join(F.transform("edges", lambda e: e["dst"].cast("string")), " ")).alias("value"))
    path = new_path(spark, "adjacency")
    lines.write.option("compression", "gzip").text(path)
    return read_adjacency_text(spark, path).edges.select("src", "dst")


@query("SELECT n_nationkey AS vertexid, [CAST(n_regionkey AS BIGINT), CAST(n_nationkey AS BIGINT)] AS edgelist FROM nation")
def record_text(spark, sf):
    line = F.format_string('{"vertexid":%di32, "edgelist":{{%di64, %di64}}}', "n_nationkey", "n_regionkey", "n_nationkey")
    return parse_records(_t(spark, sf, "nation").select(line.alias("value")), "vertexid int, edgelist array<bigint>")


@query("SELECT CAST(c_custkey AS BIGINT) AS id, make_timestamp(2020, 1, CAST(1 + c_custkey % 28 AS BIGINT), 10, 30, 0) AS seen, c_custkey + 0.5::DOUBLE AS x, 'a 3d {{x}} 5f ' || c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, [CAST(c_custkey % 7 AS BIGINT), 2] AS tags FROM customer")
def record_text_nested(spark, sf):
    """Nested records, multisets of records, datetime and point values, and strings that look like all of these."""
    line = F.format_string('{"id":%di64, "seen":datetime("2020-01-%02dT10:30:00"), "at":point("%d.5,1"), "name":"a 3d {{x}} 5f %s", "in":{"nation":{"key":%d}}, "tags":{{{"k":%d},{"k":2i8}}}}', "c_custkey", (F.lit(1) + F.col("c_custkey") % 28).cast("int"), "c_custkey", "c_name", "c_nationkey", F.col("c_custkey") % 7)
    customers = _t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    customers = customers.repartition(_tasks(customers, LINES))  # a small file would be one task, and lines are parsed in Python
    rows = parse_records(customers.select(line.alias("value")), "id bigint, seen timestamp_ntz, at struct<x:double,y:double>, name string, `in` struct<nation:struct<key:bigint>>, tags array<struct<k:bigint>>")
    return rows.select("id", "seen", F.col("at.x").alias("x"), "name", F.col("in.nation.key").alias("nation"), F.col("tags.k").alias("tags"))


@query("SELECT k AS id, 10.0::DOUBLE * k AS value, (k + 1) % 1000 AS dst, 100.0::DOUBLE * k AS weight FROM range(1000) AS r(k)")
def reader_of_vertices(spark, sf):
    """A source that Spark has no reader for: each split is read by a Python object in a task."""
    g = tables.read_vertices(spark, RingReader(1000))
    return g.vertices.join(g.edges.select("src", "dst", F.col("value").alias("weight")), F.col("id") == F.col("src")).select("id", "value", "dst", "weight")


@query("SELECT k AS id, k * k AS square FROM range(500) AS r(k)")
def generated_rows(spark, sf):
    return tables.generate(spark, list(range(0, 500, 50)), squares_from, "id bigint, square bigint")


@query(f"WITH RECURSIVE {NEXT}, {LABELS} SELECT id AS vertexid, v AS value FROM l")
def table_to_table(spark, sf):
    """A job from one table to another: rows to vertices, a run, and vertices to rows that replace the target's."""
    own, source, target = uuid.uuid4().hex, new_path(spark, "source"), new_path(spark, "target")
    rows = next_part(spark, sf).adjacency()  # sorted by target
    tables.write_table(rows, f"source_{own}", "vertexid", path=source, vertexid="id", edgelist="edges.dst", least=F.get("edges.dst", F.lit(0)))
    columns = {"vertexid": "id", "value": "value"}
    try:
        for _ in range(2):  # the second run replaces what the first has written
            tables.run_table_to_table(spark, f"source_{own}", f"target_{own}", MinLabel(), "vertexid", "edgelist", "vertexid", columns, path=target, state={"least": "least"})
        return spark.read.parquet(target)
    finally:
        tables.drop_table(spark, f"source_{own}")
        tables.drop_table(spark, f"target_{own}")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation ORDER BY n_name")
def insert_returning(spark, sf):
    """A table is made, filled by two inserts that give their rows back, read and dropped."""
    name, path = f"nations_{uuid.uuid4().hex}", new_path(spark, "nations")
    rows = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    tables.create_table(spark, name, "id bigint, name string", path)
    back = tables.insert(spark, name, rows.filter("id % 2 = 0").orderBy("name"), ["id"]).union(tables.insert(spark, name, rows.filter("id % 2 = 1"), ["id"]))
    out = spark.read.parquet(path).join(back, "id").select("id", "name")
    tables.drop_table(spark, name)
    return out


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def delimited_round_trip(spark, sf):
    path = new_path(spark, "delimited")
    _t(spark, sf, "customer").select(F.concat_ws("|", "c_custkey", "c_name", "c_nationkey", F.lit("")).alias("value")).write.text(path)
    return read_delimited(spark, path, ["c_custkey", "c_name", "c_nationkey"])


@query("SELECT CAST(s_suppkey AS VARCHAR) || chr(9) || s_name AS value FROM supplier")
def vertex_text_sink(spark, sf):
    path = new_path(spark, "vertices")
    write_vertices(_t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("value")), path)
    return spark.read.text(path)


# Learning


DIMENSIONS = 64
AXES = [f"x{i}" for i in range(DIMENSIONS)]


def _points(spark, sf) -> DataFrame:
    """The embeddings, a column for each dimension."""
    return _t(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(AXES)])


def _kmeans_sql(rounds: int) -> str:
    out = ["p AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, v FROM p ORDER BY vec_id LIMIT 3)"]
    for r in range(1, rounds + 1):
        out.append(f"a{r} AS (SELECT vec_id, any_value(p.v) AS v, arg_min(k, list_distance(p.v, c.v)) AS k FROM p, c{r - 1} c GROUP BY vec_id)")
        out.append(f"m{r} AS (SELECT k, i, avg(v[i]) AS m FROM a{r}, range(1, {DIMENSIONS + 1}) AS t(i) GROUP BY k, i), c{r} AS (SELECT c.k, coalesce(n.v, c.v) AS v FROM c{r - 1} c LEFT JOIN (SELECT k, list(m ORDER BY i) AS v FROM m{r} GROUP BY k) n ON n.k = c.k)")
    return ", ".join(out)


@query(f"WITH {_kmeans_sql(5)} SELECT CAST(k AS INTEGER) AS cluster, CAST(i - 1 AS INTEGER) AS axis, round(v[i], 6) AS centre FROM c5, range(1, {DIMENSIONS + 1}) AS t(i)")
def kmeans_5_rounds(spark, sf):
    points = _points(spark, sf)
    start = [tuple(r[c] for c in AXES) for r in points.orderBy("vec_id").limit(3).collect()]
    model = kmeans(points, AXES, start, rounds=5)
    return spark.createDataFrame([(k, i, round(x, 6)) for k, p in enumerate(model.centres) for i, x in enumerate(p)], "cluster int, axis int, centre double")


@query()
def kmeans_best_of_3(spark, sf):
    points = _points(spark, sf)
    return assign(points, AXES, kmeans_restarts(points, AXES, 3, key="vec_id").centres).select("vec_id", "cluster", "distance")


def _bgd_sql(rounds: int) -> str:
    out = ["d AS (SELECT quality * 2 - 1 AS label, 1.0::DOUBLE AS x0, n_chars::REAL / 1000::REAL AS x1 FROM labels JOIN documents USING (doc_id)), w0 AS (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 1.0::DOUBLE AS s)"]
    for r in range(1, rounds + 1):
        wrong = "(label > 0) <> (w0 * x0 + w1 * x1::DOUBLE > 0)"
        out.append(f"w{r} AS (SELECT any_value(w0) + coalesce(sum(label * x0) FILTER ({wrong}), 0) / count(*) * any_value(s) AS w0, any_value(w1) + coalesce(sum(label * x1::DOUBLE) FILTER ({wrong}), 0) / count(*) * any_value(s) AS w1, any_value(s) * 0.9::DOUBLE AS s FROM d, w{r - 1})")
    return ", ".join(out)


@query(f"WITH {_bgd_sql(4)} SELECT round(w0, 6) AS w0, round(w1, 6) AS w1 FROM w4")
def gradient_descent_4_rounds(spark, sf):
    d = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    vals = F.array(F.lit(1.0).cast("float"), F.col("n_chars").cast("float") / F.lit(1000.0).cast("float"))
    data = d.select((F.col("quality") * 2 - 1).cast("int").alias("label"), F.array(F.lit(0), F.lit(1)).alias("ids"), F.transform(vals, lambda x: x.cast("float")).alias("vals"))
    model = gradient_descent(data, 2, rounds=4)
    return spark.createDataFrame([(round(model.weights[0], 6), round(model.weights[1], 6))], "w0 double, w1 double")


_SUMS = "SELECT event_type AS key, round(sum(value), 3) AS total, CAST(count(value) AS BIGINT) AS n FROM events GROUP BY event_type"


def _reduced(spark, sf, topology: str) -> DataFrame:
    model, _ = run_rounds(as_rows(_t(spark, sf, "events").filter("value is not null"), "event_type", "value"), SumAndCount(), {}, topology)
    return spark.createDataFrame([(k, round(s, 3), c) for k, (s, c) in sorted(model.items())], "key string, total double, n bigint")


@query(_SUMS)
def reduce_none(spark, sf):
    return _reduced(spark, sf, "none")


@query(_SUMS)
def reduce_generic(spark, sf):
    return _reduced(spark, sf, "generic")


@query(_SUMS)
def reduce_nary(spark, sf):
    return _reduced(spark, sf, "nary")


@query()
def graph_sample(spark, sf):
    return sample_graph(next_part(spark, sf), 0.5).vertices
