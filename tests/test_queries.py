import glob
import heapq
import math
import os

import duckdb
import pytest

import __spark_entry__
from graphloop import queries as own

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def ordered(rows):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in own.QUERIES if n != "shortest_paths_ring"])
def test_query_against_sql(spark, con, name):
    df = own.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(df.select(*columns).collect())
    if name not in own.SQL:
        assert got
        return
    want = ordered(con.sql(f"SELECT {', '.join(columns)} FROM ({own.SQL[name]})").fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b, strict=True)), (a, b)


def dijkstra(edges, source, unit=False):
    out, best, queue = {}, {source: 0.0}, [(0.0, source)]
    for src, dst, w in edges:
        out.setdefault(src, []).append((dst, 1.0 if unit else w))
    while queue:
        d, v = heapq.heappop(queue)
        for u, w in out.get(v, []) if d == best[v] else []:
            if d + w < best.get(u, math.inf):
                best[u] = d + w
                heapq.heappush(queue, (d + w, u))
    return best


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """A chain of 12 parts, with dear short cuts, and a part that nothing leads to."""
    steps = [(k, k + 1, 1.0 + k % 3) for k in range(1, 12)] + [(1, 6, 50.0), (2, 9, 60.0), (13, 1, 1.0), (12, 3, 1.0)]
    lines = [(o, n, part, 99.0 if n == 1 else w) for o, (src, dst, w) in enumerate(steps) for n, part in ((1, src), (2, dst))]
    at = str(tmp_path_factory.mktemp("far"))
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(1, 14)], "p_partkey bigint").write.parquet(f"{at}/part.parquet")
    return at, steps


def test_hops_from_1_reach_the_fixpoint(spark, far):
    got = {r["id"]: r["hops"] for r in own.QUERIES["bfs_hops_from_1"](spark, far[0]).collect()}
    assert got == dijkstra(far[1], 1, unit=True) and max(got.values()) > 3


def test_shortest_paths_from_1_reach_the_fixpoint(spark, far):
    got = {r["id"]: r["value"] for r in own.QUERIES["shortest_paths_from_1"](spark, far[0]).collect()}
    assert got == dijkstra(far[1], 1) and got[12] == sum(w for _, _, w in far[1][:11])


def test_entry_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert {name for name in __spark_entry__.queries() if name in own.QUERIES} == set(own.QUERIES)
