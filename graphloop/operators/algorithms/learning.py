"""Learning loops: k-means, batch gradient descent, random centres. A round is one aggregation; models stay on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Point = tuple[float, ...]


@dataclass
class KMeans:
    centres: list[Point]
    distance_sum: float
    rounds: int


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each row's nearest centre (the first of equals), and the distance to it."""
    squares = np.stack([((x - c) ** 2).sum(1) for c in centres], 1)
    at = squares.argmin(1)
    return at, np.sqrt(squares[np.arange(len(x)), at])


def assign(points: DataFrame, columns: list[str], centres: list[Point]) -> DataFrame:
    """``points`` with cluster and distance."""
    c = np.array(centres, float)

    @F.pandas_udf("cluster int, distance double")
    def nearest(rows: pd.Series) -> pd.DataFrame:
        at, distance = _nearest(np.stack(rows.to_list()) if len(rows) else np.zeros((0, len(columns))), c)
        return pd.DataFrame({"cluster": at.astype(np.int32), "distance": distance})

    found = nearest(F.array(*[F.col(x).cast("double") for x in columns]))
    return points.withColumn("_nearest", found).withColumns({"cluster": F.col("_nearest.cluster"), "distance": F.col("_nearest.distance")}).drop("_nearest")


def kmeans(points: DataFrame, columns: list[str], centres: list[Point], rounds: int = 20, tolerance: float = 1e-10, sequential_update: bool = False, keep_empty: bool = True) -> KMeans:
    """Lloyd's rounds until no centre moves by more than ``tolerance`` or ``rounds`` are over; at least one runs.

    ``sequential_update`` moves only the first centre that changes in a round. An empty cluster keeps its centre, or with
    ``keep_empty`` off goes to the origin.
    """
    rows = points.select(F.array(*[F.col(x).cast("double") for x in columns]).alias("v")).persist(StorageLevel.MEMORY_AND_DISK)
    centres, total, n = list(centres), 0.0, 0
    try:
        for n in range(1, rounds + 1):
            now = np.array(centres, float)

            def partial(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
                """A task's sums by cluster: of each axis, of rows (axis -1) and of distances (axis -2)."""
                sums = np.zeros((len(now), now.shape[1] + 2))
                for batch in batches:
                    if not len(batch):
                        continue
                    x = np.stack(batch["v"].to_list())
                    at, distance = _nearest(x, now)
                    np.add.at(sums, at, np.column_stack([x, distance, np.ones(len(x))]))
                k, axis = np.indices(sums.shape)
                axis[axis >= now.shape[1]] -= now.shape[1] + 2
                yield pd.DataFrame({"k": k.ravel(), "axis": axis.ravel(), "s": sums.ravel()})

            sums = {(r[0], r[1]): r[2] for r in rows.mapInPandas(partial, "k int, axis int, s double").groupBy("k", "axis").agg(F.sum("s")).collect()}
            total = sum(sums.get((k, -2), 0.0) for k in range(len(centres)))
            changed = False
            for k, old in enumerate(centres):
                if sequential_update and changed:
                    break
                if size := sums.get((k, -1), 0.0):
                    new = tuple(sums[k, i] / size for i in range(len(columns)))
                else:
                    new = old if keep_empty else (0.0,) * len(columns)
                if any(abs(a - b) > tolerance for a, b in zip(old, new, strict=True)):
                    changed = True
                    centres[k] = new
            if not changed:
                break
    finally:
        rows.unpersist()
    return KMeans(centres, total, n)


def random_centres(points: DataFrame, columns: list[str], k: int, seed: int = 0, key: str | None = None) -> list[Point]:
    """k rows drawn at random without replacement: those of the least seeded digest of ``key`` (of the row itself without),
    so every partitioning gives the same, and each task sends k rows at most."""
    of = F.col(key).cast("string") if key else F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    rows = points.select(*columns, F.md5(F.concat(F.lit(f"{seed}:"), of)).alias("_u")).orderBy("_u").limit(k).collect()
    return [tuple(float(r[c]) for c in columns) for r in rows]


def kmeans_restarts(points: DataFrame, columns: list[str], k: int, restarts: int = 3, seed: int = 0, key: str | None = None, **options) -> KMeans:
    """The best of several starts by the sum of distances."""
    return min((kmeans(points, columns, random_centres(points, columns, k, seed + i, key), **options) for i in range(restarts)), key=lambda m: m.distance_sum)


@dataclass
class Linear:
    weights: list[float]
    step: float
    error: float
    rounds: int


def gradient_descent(data: DataFrame, features: int, rounds: int = 15, step: float = 1.0, decay: float = 0.9, tolerance: float = 1e-4) -> Linear:
    """Perceptron by batches over (label, ids, vals): a row is wrong where the signs of label and score differ.

    The weights are broadcast, and a task sends one row for each feature that changes. Each round adds the mean of label times value over all rows that were wrong, times a step that decays; it ends when
    the share of wrong rows (in per cent) is under ``tolerance``.
    """
    spark = data.sparkSession
    rows = data.select("label", "ids", "vals").persist(StorageLevel.MEMORY_AND_DISK)
    w, error, n = np.zeros(features), 100.0, 0
    try:
        for n in range(1, rounds + 1):
            sent = spark.sparkContext.broadcast(w)

            def partial(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                """Sums of a task by feature; -1 counts its rows and -2 those that are wrong."""
                g, total, wrong = np.zeros(features), 0, 0
                for batch in batches:
                    sizes = batch["ids"].map(len).to_numpy()
                    row = np.repeat(np.arange(len(batch)), sizes)
                    ids, vals = (np.concatenate([*batch[c], np.zeros(0)]) for c in ("ids", "vals"))
                    known = (ids >= 0) & (ids < features)
                    row, ids, vals = row[known], ids[known].astype(np.int64), vals[known].astype(np.float64)
                    score = np.bincount(row, sent.value[ids] * vals, minlength=len(batch))
                    label = batch["label"].to_numpy()
                    bad = (label > 0) != (score > 0)
                    total, wrong = total + len(batch), wrong + int(bad.sum())
                    g += np.bincount(ids, np.where(bad[row], label[row] * vals, 0.0), minlength=features)
                at = np.nonzero(g)[0]
                yield pd.DataFrame({"id": [-1, -2, *at.tolist()], "g": [float(total), float(wrong), *g[at].tolist()]})

            sums = dict(tuple(r) for r in rows.mapInPandas(partial, "id bigint, g double").groupBy("id").agg(F.sum("g")).collect())
            sent.destroy()
            total, wrong = sums.pop(-1, 0.0), sums.pop(-2, 0.0)
            error = 100.0 * wrong / total if total else 0.0
            for i, x in sums.items():
                w[i] += x / total * step
            step *= decay
            if error < tolerance:
                break
    finally:
        rows.unpersist()
    return Linear(w.tolist(), step, error, n)
