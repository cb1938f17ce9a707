"""Iterative map-reduce-update: map over cached data with the current model, an associative reduce, an update on the driver.

At least one round always runs. The model is broadcast each round; partial results are folded within each task, then by one
of three topologies (``none``: all partials to the update; ``generic``: k reducers; ``nary``: a tree of fan-in n), which
give the same result for an associative and commutative reduce. Errors of user code propagate.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from socket import gethostname
from typing import Any

import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LearningJob(ABC):
    """The parts of a job; ``parse`` turns raw rows into the table that is cached."""

    def parse(self, raw: DataFrame) -> DataFrame:
        return raw

    @abstractmethod
    def map(self, rows: Iterator[pd.DataFrame], model: Any) -> Any:
        """A partial result of a partition's batches, or None for nothing."""

    @abstractmethod
    def reduce(self, parts: Iterable[Any]) -> Any: ...

    @abstractmethod
    def update(self, model: Any, result: Any) -> Any: ...

    @abstractmethod
    def done(self, model: Any, round_number: int) -> bool: ...


def _folded(parts: DataFrame, job: LearningJob, groups: int) -> DataFrame:
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for rows in batches:
            for blob in rows["part"]:
                total = pickle.loads(blob) if total is None else job.reduce([total, pickle.loads(blob)])
        if total is not None:
            yield pd.DataFrame({"part": [pickle.dumps(total)]})

    return parts.repartition(groups).mapInPandas(fold, "part binary")


def run_rounds(data: DataFrame, job: LearningJob, model: Any, topology: str = "none", fan_in: int = 2, cache: str = "disk", on_round: Callable[[int, Any], None] | None = None, snapshot: Callable[[int, Any], None] | None = None) -> tuple[Any, int]:
    """The final model and the number of rounds. cache: disk, memory or none (parse again each round)."""
    if topology not in ("none", "generic", "nary") or fan_in < 1 or topology == "nary" and fan_in < 2:
        raise ValueError(f"no topology {topology!r} with {fan_in}")
    spark = data.sparkSession
    rows = job.parse(data)
    if cache != "none":
        rows = rows.persist(StorageLevel.DISK_ONLY if cache == "disk" else StorageLevel.MEMORY_AND_DISK)
    if snapshot:
        snapshot(0, model)
    n = 0
    try:
        while True:
            n += 1
            sent = spark.sparkContext.broadcast(model)

            def mapped(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                part = job.map(batches, sent.value)
                if part is not None:
                    yield pd.DataFrame({"part": [pickle.dumps(part)]})

            parts = rows.mapInPandas(mapped, "part binary")
            width = rows.rdd.getNumPartitions() if topology == "nary" else 0
            if topology == "generic":
                parts = _folded(parts, job, fan_in)
            while topology == "nary" and width > 1:
                width = -(-width // fan_in)
                parts = _folded(parts, job, width)
            got = [pickle.loads(r[0]) for r in parts.collect()]
            model = job.update(model, job.reduce(got) if got else None)
            sent.destroy()
            if snapshot:
                snapshot(n, model)
            if on_round:
                on_round(n, model)
            if job.done(model, n):
                return model, n
    finally:
        if cache != "none":
            rows.unpersist()


@dataclass(frozen=True)
class TaskInfo:
    """Where a job's ``map`` or ``reduce`` runs: the partition, the attempt, and the host."""

    partition: int
    attempt: int
    host: str


def task_info() -> TaskInfo | None:
    """Of the task that calls it; None on the driver."""
    task = TaskContext.get()
    return None if task is None else TaskInfo(task.partitionId(), task.attemptNumber(), gethostname())


class ConcatWords(LearningJob):
    """Sorted concatenation of all words, in one round."""

    def map(self, rows, model):
        return sorted(w for b in rows for w in b["word"])

    def reduce(self, parts):
        return sorted(reduce(lambda a, b: a + b, parts, []))

    def update(self, model, result):
        return model + "".join(result or [])

    def done(self, model, round_number):
        return True


class SumAndCount(LearningJob):
    """Sum and count of ``value`` by ``key`` (a bounded number of keys), in one round."""

    def map(self, rows, model):
        out: dict[str, tuple[float, int]] = {}
        for b in rows:
            for k, g in b.groupby("key")["value"]:
                s, c = out.get(k, (0.0, 0))
                out[k] = s + float(g.sum()), c + len(g)
        return out or None

    def reduce(self, parts):
        out: dict[str, tuple[float, int]] = {}
        for p in parts:
            for k, (s, c) in p.items():
                t, d = out.get(k, (0.0, 0))
                out[k] = s + t, c + d
        return out

    def update(self, model, result):
        return result or {}

    def done(self, model, round_number):
        return True


def as_rows(data: DataFrame, key: str, value: str) -> DataFrame:
    return data.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
