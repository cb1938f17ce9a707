"""Imperative vertex programs: ``compute(vertex, messages)`` in Python over partitions.

For what columns can't express: messages of any number to any vertex, mutation from within, per-partition termination.
Vertices of a partition (``pmod(id, partitions)`` by default) are processed in the order of their identifiers, as a stream
of Arrow batches; each superstep writes one tagged table to the shared folder and is split from there, and the one before is
deleted. A failed superstep is tried again from there; a run is resumed from the last table in its folder. The out-edges and
the messages of a vertex are one row, so this engine is for graphs whose hubs fit a task; column programs have no such bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloop.graph import Graph
from graphloop.plans.superstep import recoverable
from graphloop.scratch import materialise, new_path, release


@dataclass
class Vertex:
    """What ``compute`` sees and changes."""

    id: int
    value: Any
    edges: list[dict]
    superstep: int
    num_vertices: int
    halted: bool = False
    sent: list[tuple[int, Any]] = field(default_factory=list)
    added: list[tuple[int, Any, list[dict]]] = field(default_factory=list)
    deleted: list[int] = field(default_factory=list)
    ends_partition: bool = False
    ends_job: bool = False

    def send(self, to: int, message: Any) -> None:
        if message is None:
            raise ValueError("a message is null")
        self.sent.append((to, message))

    def send_to_all(self, message: Any) -> None:
        for e in self.edges:
            self.send(e["dst"], message)

    def vote_to_halt(self) -> None:
        self.halted = True

    def activate(self) -> None:
        self.halted = False

    def add_vertex(self, ident: int, value: Any = None, edges: list[dict] | None = None) -> None:
        self.added.append((ident, value, edges or []))

    def delete_vertex(self, ident: int) -> None:
        self.deleted.append(ident)

    def add_edge(self, dst: int, value: float | None = None) -> None:
        self.edges.append({"dst": dst, "value": value})

    def remove_edge(self, dst: int) -> None:
        self.edges[:] = [e for e in self.edges if e["dst"] != dst]

    def sort_edges(self) -> None:
        self.edges.sort(key=lambda e: e["dst"])

    def terminate_partition(self) -> None:
        """Votes to halt; the vertices of this partition that come later are skipped in this superstep and halt."""
        self.ends_partition = self.halted = True

    def terminate_job(self) -> None:
        self.ends_job = True


class ImperativeProgram:
    """Override ``compute``; ``configure`` runs once for each partition and superstep, ``open`` and ``close`` around a vertex."""

    value_type, message_type = "double", "double"

    def configure(self, superstep: int) -> None: ...

    def open(self, vertex: Vertex) -> None: ...

    def compute(self, vertex: Vertex, messages: list) -> None:
        raise NotImplementedError

    def close(self, vertex: Vertex) -> None: ...


def run_imperative(graph: Graph, program: ImperativeProgram, partitions: int | None = None, max_supersteps: int = 2**31 - 1, partition_by: Column | None = None, num_vertices: int | None = None, run_dir: str | None = None, resume: str | None = None, max_retries: int = 2) -> DataFrame:
    """(id, value) when every vertex has halted and no message is under way, the job is ended, or at ``max_supersteps``.

    partitions: as many as a shuffle has if none; of programs that end partitions the result depends on it. ``resume`` names
    the ``run_dir`` of a run to go on from. The result is a table there, for ``release``.
    """
    spark = graph.vertices.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    run_dir = resume or run_dir or new_path(spark, "imperative")
    place = F.pmod(F.col("id"), F.lit(partitions)) if partition_by is None else partition_by
    none = F.expr(f"cast(array() as array<{program.message_type}>)")
    empty = F.expr(f"cast(array() as array<{EDGE}>)")
    n = num_vertices or graph.vertices.count()
    shape = f"kind string, id bigint, value {program.value_type}, halted boolean, edges array<{EDGE}>, msg {program.message_type}"
    superstep, tagged = _last_step(spark, run_dir, shape) if resume else (0, None)
    while True:
        state, messages, over = _start(graph, program) if tagged is None else _split(tagged)
        if over or superstep >= max_supersteps:
            break
        superstep += 1
        bags = messages.groupBy(F.col("id").alias("to")).agg(F.collect_list("msg").alias("msgs"))
        rows = state.join(bags, F.col("id") == F.col("to"), "full_outer")
        rows = rows.select(F.coalesce("id", "to").alias("id"), "value", F.coalesce("halted", F.lit(False)).alias("halted"), F.coalesce("edges", empty).alias("edges"), F.coalesce("msgs", none).alias("msgs"))
        ordered = rows.withColumn("part", place).repartition(partitions, "part").sortWithinPartitions("part", "id")
        before = tagged
        for attempt in range(max_retries + 1):
            try:
                tagged = materialise(ordered.mapInPandas(_stepper(program, superstep, n), shape), "step", f"{run_dir}/step-{superstep:09d}")
                break
            except Exception as error:
                if attempt == max_retries or not recoverable(error):
                    raise
        if before is not None:
            release(before)
    out = state.select("id", "value")
    if tagged is not None:
        out._scratch_path = run_dir
    return out


EDGE = "struct<dst:bigint,value:double>"


def _start(graph: Graph, program: ImperativeProgram) -> tuple[DataFrame, DataFrame, bool]:
    value = (F.col("value") if "value" in graph.vertices.columns else F.lit(None)).cast(program.value_type)
    lists = graph.edges.groupBy(F.col("src").alias("_src")).agg(F.sort_array(F.collect_list(F.struct("dst", F.col("value").cast("double").alias("value")))).alias("edges"))
    state = graph.vertices.select("id", value.alias("value")).join(lists, F.col("id") == F.col("_src"), "left")
    state = state.select("id", "value", F.lit(False).alias("halted"), F.coalesce("edges", F.expr(f"cast(array() as array<{EDGE}>)")).alias("edges"))
    return state, graph.vertices.sparkSession.createDataFrame([], f"id bigint, msg {program.message_type}"), False


def _split(tagged: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Vertices after mutation, messages, and whether the run is over, from what a superstep wrote."""
    kept = tagged.filter("kind = 'vertex'").select("id", "value", "halted", "edges")
    gone = tagged.filter("kind = 'delete'").select(F.col("id").alias("_gone")).distinct()
    new = tagged.filter("kind = 'add'").select("id", "value", "halted", "edges").dropDuplicates(["id"])
    counts = dict(tagged.groupBy("kind").count().collect())
    if counts.get("delete"):
        kept = kept.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    if counts.get("add"):
        kept = kept.join(new.select(F.col("id").alias("_new")), F.col("id") == F.col("_new"), "left_anti").unionByName(new)
    over = bool(counts.get("end")) or not counts.get("message") and not counts.get("add") and tagged.filter("kind = 'vertex' and not halted").isEmpty()
    return kept, tagged.filter("kind = 'message'").select("id", "msg"), over


def _last_step(spark: SparkSession, run_dir: str, shape: str) -> tuple[int, DataFrame]:
    """The last superstep that was written whole, and its table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_dir)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().toString() for f in (fs.listStatus(folder) if fs.exists(folder) else [])]
    whole = sorted(p for p in found if "/step-" in p and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))
    if not whole:
        raise FileNotFoundError(f"{run_dir} has no superstep to resume from")
    out = spark.read.schema(shape).parquet(whole[-1])
    out._scratch_path = whole[-1]
    return int(whole[-1].rpartition("-")[2]), out


def _stepper(program: ImperativeProgram, superstep: int, n: int):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, skipping = None, False
        for rows in batches:
            out: list[tuple] = []
            for r in rows.itertuples(index=False):
                if r.part != part:
                    part, skipping = r.part, False
                    program.configure(superstep)
                value = None if r.value is None or r.value != r.value else r.value
                edges = [{"dst": int(e["dst"]), "value": e["value"]} for e in r.edges]
                if skipping or r.halted and not len(r.msgs):
                    out.append(("vertex", r.id, value, True if skipping else r.halted, edges, None))
                    continue
                v = Vertex(int(r.id), value, edges, superstep, n)
                program.open(v)
                program.compute(v, list(r.msgs))
                program.close(v)
                out.append(("vertex", v.id, v.value, v.halted, v.edges, None))
                out += [("message", to, None, None, None, m) for to, m in v.sent]
                out += [("add", i, x, False, e, None) for i, x, e in v.added]
                out += [("delete", i, None, None, None, None) for i in v.deleted]
                if v.ends_job:
                    out.append(("end", v.id, None, None, None, None))
                skipping = skipping or v.ends_partition
            columns = ["kind", "id", "value", "halted", "edges", "msg"]
            yield pd.DataFrame({c: pd.Series([x[k] for x in out], dtype=object) for k, c in enumerate(columns)})

    return step
