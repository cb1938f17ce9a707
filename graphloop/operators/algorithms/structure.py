"""Triangles and cliques."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloop.graph import Graph
from graphloop.scratch import materialise

#: Colours for cells of CELL_LEAST edges, up to COLOURS; more only where a cell would hold over CELL edges. Edges and
#: triangles are packed up to PACK at a time. Cliques are searched in up to 64 parts of PART_LEAST edges, or more of PART.
#: WEDGES paths are tried at once.
COLOURS, CELL_LEAST, CELL, PACK, PART_LEAST, PART, WEDGES = 8, 250_000, 16_000_000, 2_000_000, 20_000, 500_000, 1 << 19


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of identifiers, the first ascending, as their length and the bytes that the differences to the one before (of
    the first) and to the least (of others) need, byte by byte."""
    out = [np.int64(len(columns[0])).tobytes()]
    for k, c in enumerate(columns):
        base = c.min()
        diff = (np.diff(c, prepend=base) if k == 0 else c - base).view(np.uint64)
        width = max(1, (int(diff.max()).bit_length() + 7) // 8)
        out += [np.int64(base).tobytes(), bytes([width]), np.ascontiguousarray(diff.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return b"".join(out)


def _unpack(packed: list[bytes], columns: int) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(columns)]
    for blob in packed:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for k in range(columns):
            base, width = int(np.frombuffer(blob, np.int64, 1, at)[0]), blob[at + 8]
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at + 9).reshape(width, n).T
            diff = wide.reshape(-1).view(np.int64)
            out[k].append((np.cumsum(diff) if k == 0 else diff) + base)
            at += 9 + n * width
    return [np.concatenate(x) for x in out]


def _hashed(ids: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    x = (ids.view(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return (((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % n


def _groups(group: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns by group, ascending by the first."""
    order = np.lexsort((columns[0], group))
    group, columns = group[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, z in zip([0, *cuts], [*cuts, len(group)], strict=True):
        if z > a:
            yield int(group[a]), [c[a:z] for c in columns]


def _packed(edges: DataFrame, keys: Callable[[np.ndarray, np.ndarray], np.ndarray], to: Callable[[int], list[int]]) -> DataFrame:
    """(key, packed): edges (src, dst) packed by ``keys``, a row for each of the keys that ``to`` gives for one of these."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            for key, own in _groups(keys(u, v), [u, v]):
                every = to(key)
                yield pa.RecordBatch.from_pydict({"key": pa.array(every, pa.int64()), "packed": pa.array([_pack(own)] * len(every), pa.binary())})

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append((b.column("src").to_numpy(), b.column("dst").to_numpy()))
                n += b.num_rows
            if n >= PACK:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    return edges.select("src", "dst").mapInArrow(pack, "key bigint, packed binary")


def _closed(u: np.ndarray, v: np.ndarray) -> Iterator[np.ndarray]:
    """Triangles of edges that are there once, in batches: rows of three identifiers, ascending.

    Paths are made at the end of least degree, which has at most the root of twice the number of edges above it, so a hub
    makes few; most that aren't closed fall by a bit table of the edges.
    """
    ids = np.union1d(np.unique(u), np.unique(v))
    n = len(ids)
    small = np.int32 if n < 2**31 else np.int64  # about 35 bytes an edge in all
    a = np.searchsorted(ids, u).astype(small)
    del u
    b = np.searchsorted(ids, v).astype(small)
    del v
    ranked = np.argsort(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), kind="stable")
    rank = np.empty(n, small)
    rank[ranked] = np.arange(n, dtype=small)
    ids, a, b = ids[ranked], rank[a], rank[b]
    key = np.minimum(a, b).astype(np.int64)
    key *= n
    key += np.maximum(a, b)
    del a, b
    key.sort()
    x, y = (key // n).astype(small), (key % n).astype(small)
    left = np.cumsum(np.bincount(x, minlength=n)).astype(small)[x] - np.arange(1, len(key) + 1, dtype=small)
    shift, mix = np.uint64(64 - max(10, (16 * len(key) - 1).bit_length())), np.uint64(0x9E3779B97F4A7C15)
    bits = np.zeros(1 << (61 - int(shift)), np.uint8)
    for k in range(0, len(key), WEDGES):
        slot = (key[k : k + WEDGES].view(np.uint64) * mix) >> shift
        np.bitwise_or.at(bits, slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
    done = np.cumsum(left, dtype=np.int64)
    total, at = int(done[-1]) if len(done) else 0, 0
    while at < len(key) and (done[at - 1] if at else 0) < total:
        before = int(done[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(done, before + WEDGES, "right")))
        many = left[at:end]
        first = np.repeat(np.arange(at, end), many)
        second = np.arange(len(first)) - np.repeat(done[at:end] - many - before, many) + first + 1
        wanted = y[first].astype(np.int64) * n + y[second]
        slot = (wanted.view(np.uint64) * mix) >> shift
        may = np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
        found = np.minimum(np.searchsorted(key, wanted[may]), len(key) - 1)
        may = may[key[found] == wanted[may]]
        if len(may):
            yield np.sort(np.stack([ids[x[first[may]]], ids[y[first[may]]], ids[y[second[may]]]], axis=1), axis=1)
        at = end


def _by_cells(up: DataFrame, edges: int, give: Callable[[Iterator[np.ndarray]], Iterator[dict]], schema: str) -> DataFrame:
    """What ``give`` makes of the triangles of each cell; ``up`` holds ascending edges once, ``edges`` of them.

    Vertices have one of b colours. An edge goes to the b cells of three colours that hold its own two, so that a triangle is
    found in the cell of its colours alone, and paths are never shuffled.
    """
    b = max(1, min(COLOURS, ceil(sqrt(6 * edges / CELL_LEAST))), ceil(sqrt(6 * edges / CELL)))

    def pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        cu, cv = _hashed(u, b), _hashed(v, b)
        return np.minimum(cu, cv) * b + np.maximum(cu, cv)

    def cells(key: int) -> list[int]:
        return [(i * b + j) * b + k for i, j, k in (sorted((*divmod(key, b), c)) for c in range(b))]

    def of(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()

        def own() -> Iterator[np.ndarray]:
            for rows in _closed(*_unpack(table.column("packed").to_pylist(), 2)):
                c = np.sort(_hashed(rows.reshape(-1), b).reshape(-1, 3), axis=1)
                mine = rows[(c[:, 0] * b + c[:, 1]) * b + c[:, 2] == key]
                if len(mine):
                    yield mine

        parts = [pa.table(x) for x in give(own())]
        return pa.concat_tables(parts) if parts else pa.table(give_none)

    give_none = {f.split()[0]: pa.array([], pa.binary() if f.split()[1] == "binary" else pa.int64()) for f in schema.split(", ")}
    return _packed(up, pair, cells).groupBy("key").applyInArrow(of, schema)


def triangle_counts(graph: Graph) -> DataFrame:
    """(id, triangles): for each u, pairs v < w of greater out-neighbours with an edge from v to w.

    Each edge list is kept to the ascending edges, and parallel edges count once. A triangle counts for its least vertex.
    """
    up = materialise(graph.edges.filter("src < dst").select("src", "dst").distinct(), "edges")

    def count(found: Iterator[np.ndarray]) -> Iterator[dict]:
        for rows in found:
            u, n = np.unique(rows[:, 0], return_counts=True)
            yield {"u": u, "n": n}

    counts = _by_cells(up, up.count(), count, "u bigint, n bigint").groupBy("u").agg(F.sum("n").alias("n"))
    return graph.vertices.select("id").join(counts, F.col("id") == F.col("u"), "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("triangles"))


def triangle_total(graph: Graph) -> int:
    return triangle_counts(graph).agg(F.coalesce(F.sum("triangles"), F.lit(0))).first()[0]


def largest_cliques(u: int, later: dict[int, set[int]]) -> list[list[int]]:
    """The largest cliques of u and its later mutual neighbours, each sorted. later: for each neighbour, the neighbours it has among the others."""
    best: list[list[int]] = [[u]]

    def grow(clique: list[int], candidates: set[int], done: set[int]) -> None:
        nonlocal best
        if not candidates and not done:
            if len(clique) > len(best[0]):
                best = [sorted(clique)]
            elif len(clique) == len(best[0]) and sorted(clique) not in best:
                best.append(sorted(clique))
            return
        if len(clique) + len(candidates) < len(best[0]):
            return
        pivot = max(candidates | done, key=lambda x: len(later[x] & candidates))
        for v in sorted(candidates - later[pivot]):
            grow([*clique, v], candidates & later[v], done & later[v])
            candidates = candidates - {v}
            done = done | {v}

    grow([u], set(later), set())
    return sorted(best)


def _shown(cliques: list[list[int]]) -> str:
    return "" if len(cliques[0]) < 2 else "".join(",".join(map(str, c)) + ";" for c in cliques)


def _cliques_by_parts(graph: Graph, mutual: DataFrame, edges: int) -> DataFrame:
    """(id, cliques): ``mutual`` and its triangles meet by parts of the vertices, packed."""
    parts = max(1, min(64, ceil(edges / PART_LEAST)), ceil(edges / PART))

    def give(found: Iterator[np.ndarray]) -> Iterator[dict]:
        held, n = [], 0
        for rows in found:
            held.append(rows)
            n += len(rows)
            if n >= PACK:
                yield packed(np.concatenate(held))
                held, n = [], 0
        if held:
            yield packed(np.concatenate(held))

    def packed(rows: np.ndarray) -> dict:
        own = [(k, _pack(c)) for k, c in _groups(_hashed(rows[:, 0].copy(), parts, 1), list(rows.T))]
        return {"key": pa.array([k for k, _ in own], pa.int64()), "links": pa.array([x for _, x in own], pa.binary())}

    near = _packed(mutual, lambda u, v: _hashed(u, parts, 1), lambda key: [key]).select("key", F.col("packed").alias("near"), F.lit(None).cast("binary").alias("links"))
    links = _by_cells(mutual, edges, give, "key bigint, links binary").select("key", F.lit(None).cast("binary").alias("near"), "links")

    def of(table: pa.Table) -> pa.Table:
        u, v = _unpack(table.column("near").drop_null().to_pylist(), 2)
        a, b, c = _unpack(table.column("links").drop_null().to_pylist(), 3)
        order, at = np.argsort(u, kind="stable"), np.argsort(a, kind="stable")
        u, v, a, b, c = u[order], v[order], a[at], b[at], c[at]
        ids, starts = np.unique(u, return_index=True)
        ends = [*starts[1:].tolist(), len(u)]
        first, last = np.searchsorted(a, ids).tolist(), np.searchsorted(a, ids, "right").tolist()
        out = []
        for i, s, e, f, z in zip(ids.tolist(), starts.tolist(), ends, first, last, strict=True):
            if f == z:  # no two of its neighbours are linked
                out.append("".join(f"{i},{x};" for x in np.sort(v[s:e]).tolist()))
                continue
            later: dict[int, set[int]] = {x: set() for x in v[s:e].tolist()}
            for x, y in zip(b[f:z].tolist(), c[f:z].tolist(), strict=True):
                later[x].add(y)
                later[y].add(x)
            out.append(_shown(largest_cliques(i, later)))
        return pa.table({"u": ids, "found": pa.array(out, pa.string())})

    found = near.unionByName(links).groupBy("key").applyInArrow(of, "u bigint, found string")
    return graph.vertices.select("id").join(found, F.col("id") == F.col("u"), "left").select("id", F.coalesce("found", F.lit("")).alias("cliques"))


def maximal_cliques(graph: Graph, prune_by: int | None = None) -> DataFrame:
    """(id, cliques): the largest cliques of each vertex with its later mutual neighbours, as ``a,b,c;a,d,e;``.

    With ``prune_by`` n, vertices of one remainder of id by n are taken in order, and those whose cliques are smaller than
    the largest so far are blank. A vertex alone is blank.
    """
    low, high = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    ways = graph.edges.filter("src <> dst").select(low, high, F.when(F.col("src") < F.col("dst"), 1).otherwise(2).alias("way"))
    mutual = materialise(ways.groupBy("src", "dst").agg(F.bit_or("way").alias("ways")).filter("ways = 3").select("src", "dst"), "mutual")
    edges = mutual.count()
    if prune_by is None:
        return _cliques_by_parts(graph, mutual, edges)
    pairs = _by_cells(mutual, edges, lambda found: ({"u": r[:, 0], "v": r[:, 1], "w": r[:, 2]} for r in found), "u bigint, v bigint, w bigint")
    links = pairs.groupBy("u").agg(F.collect_list(F.struct("v", "w")).alias("links"))
    near = mutual.groupBy(F.col("src").alias("u1")).agg(F.collect_list("dst").alias("near"))
    hoods = graph.vertices.select("id").join(near, F.col("id") == F.col("u1"), "left").join(links, F.col("id") == F.col("u"), "left").select("id", "near", "links")

    def of(row) -> list[list[int]]:
        later: dict[int, set[int]] = {int(v): set() for v in (row.near if row.near is not None else [])}
        for link in row.links if row.links is not None else []:
            later[link["v"]].add(link["w"])
            later[link["w"]].add(link["v"])
        return largest_cliques(int(row.id), later)

    def in_order(rows: pd.DataFrame) -> pd.DataFrame:
        out, most = [], 0
        for r in rows.sort_values("id").itertuples():
            cliques = of(r)
            out.append((r.id, _shown(cliques) if len(cliques[0]) >= most else ""))
            most = max(most, len(cliques[0]))
        return pd.DataFrame(out, columns=["id", "cliques"])

    return hoods.groupBy(F.pmod("id", F.lit(prune_by))).applyInPandas(in_order, "id long, cliques string")
