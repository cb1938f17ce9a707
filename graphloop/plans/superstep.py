"""Bulk-synchronous vertex programs as relational plans.

A program is a set of Column expressions, so every superstep is one DataFrame plan: messages are the join of sending
vertices with their out-edges, combined by a partial and a final aggregation on the target; they meet the vertex table, and
the new state is written as a Parquet snapshot. The snapshot cuts the lineage, survives lost executors and is what a
resumed run starts from. A second, small action over the snapshot gives the vote to halt and the global aggregates.

``Plan.FULL_SCAN`` joins messages with all vertices (full outer) and writes all of them. ``Plan.FRONTIER`` touches only
vertices with a message or without a vote to halt: it writes them as a change to the last whole snapshot, with earlier
changes that still count, and the untouched rest is neither shuffled nor written. Changes of over ``COMPACT`` of the vertices
are merged into a whole snapshot. ``Plan.AUTO`` takes the frontier when under ``AUTO_RATIO`` of the vertices are active.

Edges are dealt once, by source and a salt: a source with n out-edges has one salt for every ``SPLIT`` of them, and its row
is repeated for each when it sends, so a hub's edges are spread over tasks. They are dealt and sorted once, ``SLICE`` to a
task; supersteps move vertices and messages only, by merge joins: no table of vertices goes through the driver. Programs may mutate the graph between
supersteps: vertices delete themselves, add others, and add or remove edges of their own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from enum import Enum

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloop.graph import Graph
from graphloop.operators.combine import UserCombiner, combine_messages, combiner
from graphloop.scratch import new_path, remove

AUTO_RATIO, COMPACT, SPLIT, SLICE = 0.2, 0.25, 20_000, 1_000_000


class Plan(Enum):
    FULL_SCAN = "full_scan"
    FRONTIER = "frontier"
    AUTO = "auto"


@dataclass(frozen=True)
class Context:
    """What a program sees in a superstep (numbered from 1): counts, the last superstep, earlier global aggregates."""

    superstep: int
    num_vertices: int
    num_edges: int
    last: int
    aggregates: dict = field(default_factory=dict)


class VertexProgram:
    """Override the expressions. Columns at hand: id, the state columns, out_degree, msg (null without a message).

    A message reactivates a vertex that has voted to halt. Messages to unknown identifiers create vertices with null state
    and no edges, unless ``create_missing`` is off.
    """

    #: State columns and their SQL types; a message's SQL type; how messages to one vertex are combined (a name, a function
    #: of a column, or a ``UserCombiner``).
    state: dict[str, str] = {"value": "double"}
    message_type = "double"
    combine: str | Callable[[Column], Column] | UserCombiner = "sum"
    create_missing = True
    #: Whether the methods below that mutate the graph are asked.
    mutates = False

    def compute(self, ctx: Context) -> dict[str, Column]:
        """New values of state columns for active vertices."""
        raise NotImplementedError

    def halt(self, ctx: Context) -> Column:
        """Whether an active vertex votes to halt (seen after compute)."""
        return F.lit(True)

    def sends(self, ctx: Context) -> Column:
        """Whether an active vertex sends along its out-edges; ``old_<state>`` columns hold the state before compute."""
        return F.lit(False)

    def message(self, ctx: Context) -> Column:
        """The message, over the sender's new state and the edge's ``dst`` and ``edge_value``; null isn't allowed."""
        return F.lit(None)

    def send_along(self, ctx: Context) -> Column | None:
        """An optional condition on edges, over the same columns as ``message``."""
        return None

    def aggregates(self, ctx: Context) -> dict[str, Column]:
        """Global aggregates over all vertices after compute."""
        return {}

    def stop(self, ctx: Context, aggregates: dict) -> bool:
        """Whether the job ends after this superstep whatever the votes."""
        return False

    def deletes(self, ctx: Context) -> Column:
        """Whether an active vertex deletes itself, and its out-edges, after this superstep."""
        return F.lit(False)

    def adds_vertices(self, ctx: Context) -> Column | None:
        """An array of structs of id and state columns: vertices that an active vertex adds. They are awake, replace one of
        their identifier, and take part from the next superstep on; deletes come before. Messages sent to them arrive."""
        return None

    def sends_to(self, ctx: Context) -> Column | None:
        """An array of structs (to, msg): messages of an active vertex to any vertices, besides those along edges."""
        return None

    def adds_edges(self, ctx: Context) -> Column | None:
        """An array of structs (dst, value): out-edges that an active vertex adds to its own."""
        return None

    def keeps_edge(self, ctx: Context) -> Column | None:
        """Over an active vertex's state and its edges' ``dst`` and ``edge_value``: whether an edge stays."""
        return None

    def before_superstep(self, ctx: Context) -> None:
        """Runs on the driver before each superstep."""

    def end_superstep(self, ctx: Context, aggregates: dict) -> None:
        """Runs on the driver after each superstep, with its aggregates."""


@dataclass
class Result:
    vertices: DataFrame
    supersteps: int
    aggregates: dict
    plans: list[str]
    num_vertices: int = 0  # as the program saw it


def _salts(degree: str) -> Column:
    """How many salts the out-edges of a source with that many have."""
    return F.greatest(F.ceil(F.col(degree) / F.lit(SPLIT)), F.lit(1)).cast("int")


def _deal(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, edge_value) dealt by source and salt, cached; and the out-degrees (_src, out_degree), cached as well.

    Lost parts are computed again. The joins of all supersteps then move vertices only, and needn't sort edges.
    """
    degrees = edges.groupBy(F.col("src").alias("_src")).agg(F.count("*").alias("out_degree")).persist(StorageLevel.MEMORY_AND_DISK)
    count = degrees.agg(F.sum("out_degree")).first()[0] or 0
    hubs = degrees.filter(F.col("out_degree") > SPLIT).select(F.col("_src").alias("_hub"), _salts("out_degree").alias("_n"))
    salted = edges.join(F.broadcast(hubs), F.col("src") == F.col("_hub"), "left")  # one row for SPLIT edges at most
    salt = F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.col("_n"))).cast("int")
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-count // SLICE))
    dealt = salted.select("src", salt.alias("salt"), "dst", "edge_value").repartition(tasks, "src", "salt").sortWithinPartitions("src", "salt").persist(StorageLevel.MEMORY_AND_DISK)
    dealt.count()  # from then on plans know how it is dealt
    dealt._degrees = degrees
    return dealt, degrees


def _free(dealt: DataFrame) -> None:
    dealt._degrees.unpersist()
    dealt.unpersist()


@contextmanager
def dealt(graph: Graph) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The edges of ``graph`` for the option ``dealt`` of several runs over them."""
    own = _deal(graph.edges.select("src", "dst", F.col("value").alias("edge_value")))
    try:
        yield own
    finally:
        _free(own[0])


def _along(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` of vertices with id and out_degree, joined with their out-edges."""
    salted = rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), _salts("out_degree") - 1)))
    return edges.join(salted.hint("merge"), (F.col("src") == F.col("id")) & (F.col("salt") == F.col("_salt"))).drop("_salt", "salt", "src")


def _messages(state: DataFrame, edges: DataFrame, program: VertexProgram, ctx: Context) -> DataFrame:
    """(to, msg): combined messages of the vertices that sent in the superstep of ``ctx``."""
    joined = _along(state.filter(F.col("sent") & (F.col("at") == ctx.superstep)), edges)
    along = program.send_along(ctx)
    rows = joined if along is None else joined.filter(along)
    checked = rows.select(F.col("dst").alias("to"), F.assert_true(program.message(ctx).isNotNull(), "a message is null").alias("_ok"), program.message(ctx).cast(program.message_type).alias("m"))
    sent = checked.filter(F.col("_ok").isNull()).select("to", "m")
    if program.mutates and program.sends_to(ctx) is not None:
        own = state.filter((F.col("at") == ctx.superstep) & F.col("mail").isNotNull()).select(F.explode("mail").alias("x"))
        sent = sent.union(own.select(F.col("x.to").cast("bigint"), F.col("x.msg").cast(program.message_type)))
    if isinstance(program.combine, UserCombiner):
        return combine_messages(sent, program.combine, "to", "m").withColumnRenamed("m", "msg")
    return sent.groupBy("to").agg(combiner(program.combine)(F.col("m")).alias("msg"))


def _compute(rows: DataFrame, program: VertexProgram, ctx: Context) -> DataFrame:
    """Applies the program to rows of id, state, halted, out_degree, msg."""
    old = {f"old_{c}": F.col(c) for c in program.state}
    active = (~F.coalesce("halted", F.lit(False))) | F.col("msg").isNotNull()
    rows = rows.withColumns({**old, "_active": active, "out_degree": F.coalesce("out_degree", F.lit(0).cast("long"))})
    new = program.compute(ctx)
    state = {c: F.when(F.col("_active"), new[c].cast(t)).otherwise(F.col(c)) if c in new else F.col(c).cast(t) for c, t in program.state.items()}
    rows = rows.withColumns(state)
    sent = F.col("_active") & (F.col("out_degree") > 0) & F.coalesce(program.sends(ctx), F.lit(False))
    rows = rows.withColumns({"sent": sent, "halted": F.when(F.col("_active"), program.halt(ctx)).otherwise(True), "at": F.lit(ctx.superstep)})
    extra = {}
    if program.mutates:
        mail, vertices, links = program.sends_to(ctx), program.adds_vertices(ctx), program.adds_edges(ctx)
        keeps = program.keeps_edge(ctx)
        extra = {"gone": F.col("_active") & F.coalesce(program.deletes(ctx), F.lit(False)), "mail": mail, "new": vertices, "links": links, "checks": F.col("_active") & F.lit(keeps is not None)}
        extra = {k: (v if k in ("gone", "checks") else F.lit(None) if v is None else F.when(F.col("_active"), v)) for k, v in extra.items()}
    born = ["born"] if "born" in rows.columns else []
    return rows.select("id", *program.state, "halted", "sent", "out_degree", "at", *[v.alias(k) for k, v in extra.items()], *born)


def _step(before: State, edges: DataFrame, program: VertexProgram, ctx: Context, last: Context, plan: Plan, awake: int) -> DataFrame:
    """The new state of all vertices (full scan), or of those that are touched (frontier)."""
    latest = before.whole if before.changed is None else before.changed  # holds all that have sent, and all that are awake
    messages = _messages(latest, edges, program, last)
    columns = ["id", *program.state, "halted", "out_degree"]
    if plan is Plan.FULL_SCAN:
        joined = before.rows().select(*columns).join(messages.hint("merge"), F.col("id") == F.col("to"), "full_outer" if program.create_missing else "left")
        return _compute(joined.withColumn("id", F.coalesce("id", "to")).drop("to"), program, ctx)
    touched = messages
    if awake:
        up = latest.filter(~F.col("halted")).select(F.col("id").alias("_awake"))
        touched = messages.join(up.hint("merge"), F.col("to") == F.col("_awake"), "full_outer").select(F.coalesce("to", "_awake").alias("to"), "msg")
    hit, known = touched.join(before.whole.select(*columns).hint("merge"), F.col("to") == F.col("id"), "left"), F.col("id").isNotNull()
    if before.changed is not None:
        newer = before.changed.select(*[F.col(c).alias(f"_new_{c}") for c in columns])
        hit = hit.join(newer.hint("merge"), F.col("to") == F.col("_new_id"), "left")
        hit = hit.select("to", "msg", *[F.when(F.col("_new_id").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in columns])
    hit = hit.withColumn("born", ~known)
    if not program.create_missing:
        hit = hit.filter(known)
    return _compute(hit.withColumn("id", F.col("to")).drop("to"), program, ctx)


@dataclass
class State:
    """All vertices: a whole snapshot, and the rows that have changed since, which take the place of its own."""

    whole: DataFrame
    whole_path: str
    changed: DataFrame | None = None
    changed_path: str | None = None
    counts: dict = field(default_factory=dict)  # after a frontier step: of the vertices that it touched

    def rows(self) -> DataFrame:
        if self.changed is None:
            return self.whole
        return _without(self.whole, self.changed).unionByName(self.changed)

    def paths(self) -> set[str]:
        return {p for p in (self.whole_path, self.changed_path) if p}


def _without(rows: DataFrame, others: DataFrame) -> DataFrame:
    return rows.join(others.select(F.col("id").alias("_other")).hint("merge"), F.col("id") == F.col("_other"), "left_anti")


def _mutated(made: DataFrame, edges: DataFrame, program: VertexProgram, ctx: Context, run_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges after the mutations that the rows of ``made`` (a snapshot) ask for."""
    gone = made.filter("gone").select("id")
    kept = _without(made, gone)
    changed = None
    keeps = program.keeps_edge(ctx)
    if keeps is not None or program.adds_edges(ctx) is not None or not gone.isEmpty():
        plain = edges.select("src", "dst", "edge_value")
        left = plain.join(gone.withColumnRenamed("id", "_other"), F.col("src") == F.col("_other"), "left_anti")
        if keeps is not None:
            judged = _along(made.filter("checks"), edges).filter(~F.coalesce(keeps, F.lit(True))).select(F.col("id").alias("_s"), F.col("dst").alias("_d")).distinct()
            left = left.join(judged, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_anti")
        if program.adds_edges(ctx) is not None:
            added = kept.filter("links is not null").select("id", F.explode("links").alias("x"))
            left = left.union(added.select("id", F.col("x.dst").cast("bigint"), F.col("x.value").cast(edges.schema["edge_value"].dataType)))
        changed = _snapshot(left, f"{run_dir}/edges-{ctx.superstep}")
    if program.adds_vertices(ctx) is not None:
        new = made.filter("new is not null").select(F.explode("new").alias("x"))
        state = [F.col(f"x.{c}").cast(t).alias(c) for c, t in program.state.items()]
        new = new.select(F.col("x.id").cast("bigint").alias("id"), *state, F.lit(False).alias("halted"), F.lit(False).alias("sent"), F.lit(0).cast("bigint").alias("out_degree"), F.lit(ctx.superstep).alias("at")).dropDuplicates(["id"])
        kept = _without(kept, new).unionByName(new, allowMissingColumns=True)
    if changed is None:
        return kept.drop("gone", "new", "links", "checks"), edges
    dealt, degrees = _deal(changed)
    kept = kept.drop("out_degree").join(degrees, F.col("id") == F.col("_src"), "left").drop("_src").withColumn("out_degree", F.coalesce("out_degree", F.lit(0).cast("long")))
    return kept.drop("gone", "new", "links", "checks"), dealt


def _snapshot(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _counts(state: DataFrame, ctx: Context, own: dict[str, Column]) -> dict:
    mail = F.col("mail").isNotNull() if "mail" in state.columns else F.lit(False)
    sending = (F.col("sent") | mail) & (F.col("at") == ctx.superstep)
    born = F.sum(F.col("born").cast("long")) if "born" in state.columns else F.lit(0)
    row = state.agg(F.count("*").alias("n"), F.sum(sending.cast("long")).alias("sending"), F.sum((~F.col("halted")).cast("long")).alias("awake"), born.alias("born"), *[v.alias(k) for k, v in own.items()]).first().asDict()
    return {"n": row["n"], "sending": row["sending"] or 0, "awake": row["awake"] or 0, "born": row["born"] or 0, "own": {k[2:]: row[k] for k in own}}


def _barrier(state: State, program: VertexProgram, ctx: Context, before: int) -> dict:
    """Votes, active vertices, counts and the program's aggregates in one action; ``before`` is the count of vertices. After a
    frontier step without aggregates, what is untouched has voted to halt and counts as it did."""
    own = {f"a_{k}": v for k, v in program.aggregates(ctx).items()}
    if state.counts and not own:
        return {"n": before + state.counts["born"], "sending": state.counts["sending"], "awake": state.counts["awake"], "own": {}}
    found = _counts(state.rows(), ctx, own)
    return {k: found[k] for k in ("n", "sending", "awake", "own")}


def run_program(
    graph: Graph,
    program: VertexProgram,
    max_supersteps: int = 2**31 - 1,
    plan: Plan = Plan.AUTO,
    num_vertices: int | None = None,
    num_edges: int | None = None,
    on_superstep: Callable[[Context, dict], None] | None = None,
    keep_every: int = 0,
    keep_when: Callable[[int], bool] | None = None,
    resume: str | None = None,
    run_dir: str | None = None,
    max_retries: int = 2,
    dealt: tuple[DataFrame, DataFrame] | None = None,
) -> Result:
    """Runs ``program`` until no vertex is awake and no message is under way, ``program.stop``, or ``max_supersteps``.

    ``num_vertices`` overrides what programs see as the count. Snapshots are kept every ``keep_every`` supersteps or where
    ``keep_when`` says so, in ``run_dir``; ``resume`` names the ``run_dir`` of a run to go on from. A failed superstep is
    tried again from the last snapshot, ``max_retries`` times, and then raises. ``dealt`` are the graph's edges from the
    function of that name, for several runs over the same ones.
    """
    spark = graph.vertices.sparkSession
    run_dir = resume or run_dir or new_path(spark, "run")
    edges, degrees = dealt or _deal(graph.edges.select("src", "dst", F.col("value").alias("edge_value")))
    given = edges if dealt else None
    start = None
    done, aggregates, names = _last_snapshot(spark, run_dir) if resume else (0, {}, [])
    if not done:
        start = _snapshot(_start(graph, program, degrees), f"{run_dir}/start")
        v = start.count()
        counts = num_vertices or v, num_edges or degrees.agg(F.sum("out_degree")).first()[0] or 0
    else:
        counts = tuple(aggregates.pop("_counts"))
        if program.mutates:
            if edges is not given:
                _free(edges)
            edges, _ = _deal(spark.read.parquet(f"{run_dir}/edges-kept-{done}"))
    state = State(spark.read.parquet(f"{run_dir}/{done}"), f"{run_dir}/{done}") if done else None
    ctx = Context(done, *counts, max_supersteps, aggregates)
    barrier = _barrier(state, program, ctx, 0) if done else {}
    chosen: list[str] = list(names)
    edges_at = 0
    keeps = lambda n: bool(n and (keep_every and n % keep_every == 0 or keep_when is not None and keep_when(n)))
    while not done or (done < max_supersteps and (barrier["sending"] or barrier["awake"]) and not program.stop(ctx, ctx.aggregates)):
        last, ctx = ctx, Context(done + 1, *counts, max_supersteps, ctx.aggregates)
        program.before_superstep(ctx)
        for attempt in range(max_retries + 1):
            try:
                new, name, after = _advance(start, program, state, edges, ctx, last, plan, barrier, run_dir, keeps(ctx.superstep))
                barrier = _barrier(new, program, ctx, barrier.get("n", 0))
                break
            except Exception as error:
                if attempt == max_retries or not recoverable(error):
                    raise
        chosen.append(name)
        ctx = Context(ctx.superstep, *counts, max_supersteps, barrier["own"])
        for path in (state.paths() if state else set()) - new.paths():
            name = path.rpartition("/")[2]
            if not (name.isdigit() and keeps(int(name))):
                remove(spark, path)
        if start is not None:
            remove(spark, f"{run_dir}/start")
            start = None
        if after is not edges:
            if edges is not given:
                _free(edges)
            if edges_at:
                remove(spark, f"{run_dir}/edges-{edges_at}")
            edges, edges_at = after, ctx.superstep
        done, state = ctx.superstep, new
        if keeps(done):
            if program.mutates:
                _snapshot(edges.select("src", "dst", "edge_value"), f"{run_dir}/edges-kept-{done}")
            meta = json.dumps({"superstep": done, "aggregates": barrier["own"] | {"_counts": list(counts)}, "plans": chosen}, default=str)
            spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{run_dir}/meta-{done:09d}")
        program.end_superstep(ctx, barrier["own"])
        if on_superstep:
            on_superstep(ctx, barrier)
    if edges is not given:
        _free(edges)
    return Result(state.rows().select("id", *program.state), done, ctx.aggregates, chosen, counts[0])


def _start(graph: Graph, program: VertexProgram, degrees: DataFrame) -> DataFrame:
    """The vertices before the first superstep."""
    own = graph.vertices.select("id", *[(F.col(c) if c in graph.vertices.columns else F.lit(None)).cast(t).alias(c) for c, t in program.state.items()])
    return own.join(degrees.hint("merge"), F.col("id") == F.col("_src"), "left").drop("_src")


def _advance(start: DataFrame | None, program: VertexProgram, state: State | None, edges: DataFrame, ctx: Context, last: Context, plan: Plan, barrier: dict, run_dir: str, keep: bool) -> tuple[State, str, DataFrame]:
    """The state after one superstep, the plan that made it, and the edges."""
    path, counts = f"{run_dir}/{ctx.superstep}", {}
    if state is None:
        rows = start.withColumns({"halted": F.lit(False), "msg": F.lit(None).cast(combined_type(program))})
        made, name = _compute(rows, program, ctx), "scan"
    else:
        busy = barrier["sending"] + barrier["awake"]
        way = plan if plan is not Plan.AUTO else Plan.FRONTIER if busy < AUTO_RATIO * barrier["n"] else Plan.FULL_SCAN
        made, name = _step(state, edges, program, ctx, last, way, barrier["awake"]), way.value
        if way is Plan.FRONTIER:
            touched = _snapshot(made, f"{path}-touched")
            if program.mutates:
                touched = touched.drop("born")
                made = _without(state.rows(), touched).unionByName(touched, allowMissingColumns=True)
                made = made.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("gone", "checks")})
            else:
                counts = _counts(touched, ctx, {})
                merged, merged_path, many = touched.drop("born"), f"{path}-touched", counts["n"]
                if state.changed is not None:
                    merged_path = f"{path}-changed"
                    merged = _snapshot(_without(state.changed, merged).unionByName(merged), merged_path)
                    remove(touched.sparkSession, f"{path}-touched")
                    many = merged.count()
                if not keep and many <= COMPACT * barrier["n"]:
                    return State(state.whole, state.whole_path, merged, merged_path, counts), name, edges
                made = _without(state.whole, merged).unionByName(merged)
    if not program.mutates:
        new = _snapshot(made, path)
    else:
        asked = _snapshot(made, f"{path}-asked")
        kept, edges = _mutated(asked, edges, program, ctx, run_dir)
        new = _snapshot(kept, path)
        remove(new.sparkSession, f"{path}-asked")
    for made_before in ("touched", "changed"):
        remove(new.sparkSession, f"{path}-{made_before}")
    return State(new, path, counts=counts), name, edges


def combined_type(program: VertexProgram) -> str:
    if isinstance(program.combine, UserCombiner):
        return program.combine.result_type
    return f"array<{program.message_type}>" if program.combine == "collect" else program.message_type


def recoverable(error: Exception) -> bool:
    """Whether another attempt may help: lost tasks and storage do, a program's own errors and bad plans don't."""
    from pyspark.errors import AnalysisException, ParseException, PythonException

    said = str(error)
    return not isinstance(error, AnalysisException | ParseException | PythonException | AssertionError | TypeError | ValueError | NotImplementedError) and not any(x in said for x in ("USER_RAISED_EXCEPTION", "a message is null", "PythonException", "DIVIDE_BY_ZERO"))


def _last_snapshot(spark: SparkSession, run_dir: str) -> tuple[int, dict, list[str]]:
    try:
        found = spark.read.text(f"{run_dir}/meta-*").collect()
    except Exception as error:
        raise FileNotFoundError(f"{run_dir} has no snapshot to resume from") from error
    meta = max((json.loads(r[0]) for r in found), key=lambda m: m["superstep"])
    return meta["superstep"], meta["aggregates"], meta["plans"]
