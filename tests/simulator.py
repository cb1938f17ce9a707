"""A plain message-passing simulator and small graphs, to hold the engine's results against."""

from __future__ import annotations

from collections import defaultdict


def webmap(complex_: bool = False) -> dict[int, list[int]]:
    g = {0: [1]} | {i: list(range(1, i + 2)) for i in range(1, 10)} | {10: [11]} | {i: list(range(11, i + 2)) for i in range(11, 19)} | {19: [0, *range(11, 20)]}
    if complex_:
        g[0] = [*g[0], 50]
        g[10] = [*g[10], 99]
        g[11] = [*g[11], 101]
        g |= {21: [22, 23, 24], 25: [], 27: []}
    return g


def pagerank(g: dict[int, list[int]], n: int, last: int) -> dict[int, float | None]:
    value: dict[int, float | None] = dict.fromkeys(g)
    inbox: dict[int, list[float]] = {}
    for step in range(1, last + 1):
        for v in inbox:
            value.setdefault(v, None)
        out = defaultdict(list)
        for v in value:
            value[v] = 1 / n if step == 1 else 0.15 / n + 0.85 * sum(inbox.get(v, []))
            if step < last:
                for d in g.get(v, []):
                    out[d].append(value[v] / len(g[v]))
        inbox = out
    return value


def min_label(g: dict[int, list[int]]) -> dict[int, int]:
    label = {v: min([v, *g[v]]) for v in g}
    inbox = defaultdict(list)
    for v in g:
        if label[v] < v:
            for d in g[v]:
                if d > label[v]:
                    inbox[d].append(label[v])
    while inbox:
        out = defaultdict(list)
        for v, ms in inbox.items():
            if v not in label or min(ms) < label[v]:
                label[v] = min(ms)
                for d in g.get(v, []):
                    out[d].append(label[v])
        inbox = out
    return label
