import itertools
import random

import pytest

from graphloop.graph import Graph
from graphloop.operators.algorithms import maximal_cliques, structure, triangle_counts


@pytest.fixture
def cells(monkeypatch):
    """So small cells and parts that a small graph has many of them."""
    monkeypatch.setattr(structure, "CELL_LEAST", 60)
    monkeypatch.setattr(structure, "PART", 40)


def a_graph(spark):
    """Identifiers far apart and below zero, a hub, some edges one way only, self loops and parallel edges."""
    rng, name = random.Random(6), [3 * k - 40 + (k % 5) * 10**12 for k in range(60)]
    pairs = {tuple(rng.sample(name, 2)) for _ in range(500)} | {(name[0], x) for x in name[1:]}
    both = pairs | {(b, a) for a, b in pairs if rng.random() < 0.8}
    rows = [*both, *[(x, x) for x in name[:3]], *list(both)[:20]]
    ids = spark.createDataFrame([(x,) for x in [*name, 77]], "id bigint")
    return both, [*name, 77], Graph(ids, spark.createDataFrame(rows, "src bigint, dst bigint").selectExpr("src", "dst", "cast(null as double) value"))


def paths_joined(df) -> bool:
    return "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()


def test_triangles_of_cells_equal_brute_force(spark, cells):
    edges, ids, graph = a_graph(spark)
    up = {e for e in edges if e[0] < e[1]}
    want = dict.fromkeys(ids, 0)
    for u, v, w in itertools.combinations(sorted(ids), 3):
        want[u] += (u, v) in up and (v, w) in up and (u, w) in up
    df = triangle_counts(graph)
    assert not paths_joined(df)  # which a cluster would have to shuffle
    assert {r["id"]: r["triangles"] for r in df.collect()} == want and sum(want.values()) > 200


def test_cliques_of_cells_equal_brute_force(spark, cells):
    edges, ids, graph = a_graph(spark)
    later = {u: {v for v in ids if u < v and (u, v) in edges and (v, u) in edges} for u in ids}
    want = {}
    for u in ids:
        most, grown = [[u]], [[u]]
        while grown:
            grown = [[*c, v] for c in grown for v in sorted(later[u]) if v > c[-1] and all(v in later[x] for x in c)]
            most = grown or most
        want[u] = "" if len(most[0]) < 2 else "".join(",".join(map(str, c)) + ";" for c in sorted(most))
    df = maximal_cliques(graph)
    assert not paths_joined(df)
    got = {r["id"]: r["cliques"] for r in df.collect()}
    assert got == want and any(x.count(",") > 2 for x in want.values()) and want[77] == ""
    pruned = {r["id"]: r["cliques"] for r in maximal_cliques(graph, prune_by=1).collect()}
    assert all(pruned[u] in ("", want[u]) for u in ids) and any(pruned.values())
