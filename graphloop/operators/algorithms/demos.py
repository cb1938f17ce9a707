"""Programs that exercise the engine: mutation, early termination, many messages, state of varying size, failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloop.operators.combine import UserCombiner
from graphloop.plans.imperative import ImperativeProgram, Vertex
from graphloop.plans.superstep import Context, VertexProgram
from graphloop.sources.tables import VertexReader


class Mutation(ImperativeProgram):
    """Superstep 1, identifiers under 100: multiples of 2 or 3 delete themselves, others add a vertex at 100 times theirs."""

    def compute(self, vertex: Vertex, messages: list) -> None:
        if vertex.superstep == 1 and vertex.id < 100:
            vertex.value = 0.0
            if vertex.id % 2 == 0 or vertex.id % 3 == 0:
                vertex.delete_vertex(vertex.id)
            else:
                vertex.add_vertex(100 * vertex.id, 0.0)
                vertex.send(100 * vertex.id, 1.0)
        elif vertex.superstep > 1 and vertex.id == 1900:
            vertex.delete_vertex(1900)
        vertex.vote_to_halt()


class ColumnMutation(VertexProgram):
    """The same as a column program."""

    mutates = True

    def compute(self, ctx: Context) -> dict[str, Column]:
        return {"value": F.when(F.col("id") < 100, F.lit(0.0)).otherwise(F.col("value"))} if ctx.superstep == 1 else {}

    def _split(self) -> Column:
        return (F.col("id") % 2 == 0) | (F.col("id") % 3 == 0)

    def deletes(self, ctx: Context) -> Column:
        return (F.col("id") < 100) & self._split() if ctx.superstep == 1 else F.col("id") == 1900

    def _others(self, ctx: Context, made: Column) -> Column:
        return F.when((F.col("id") < 100) & ~self._split() & F.lit(ctx.superstep == 1), F.array(made))

    def adds_vertices(self, ctx: Context) -> Column:
        return self._others(ctx, F.struct((F.col("id") * 100).alias("id"), F.lit(0.0).alias("value")))

    def sends_to(self, ctx: Context) -> Column:
        return self._others(ctx, F.struct((F.col("id") * 100).alias("to"), F.lit(1.0).alias("msg")))


class Rewire(VertexProgram):
    """Superstep 1 drops out-edges to even identifiers and adds one to itself; 2 sends along what there is; 3 counts."""

    mutates = True
    state, message_type = {"value": "bigint"}, "bigint"

    def compute(self, ctx: Context) -> dict[str, Column]:
        return {"value": F.coalesce("msg", F.lit(0).cast("bigint"))}

    def keeps_edge(self, ctx: Context) -> Column | None:
        return F.col("dst") % 2 == 1 if ctx.superstep == 1 else None

    def adds_edges(self, ctx: Context) -> Column | None:
        return F.array(F.struct(F.col("id").alias("dst"), F.lit(None).cast("double").alias("value"))) if ctx.superstep == 1 else None

    def sends(self, ctx: Context) -> Column:
        return F.lit(ctx.superstep == 2)

    def message(self, ctx: Context) -> Column:
        return F.lit(1).cast("bigint")

    def halt(self, ctx: Context) -> Column:
        return F.lit(ctx.superstep >= 2)


class Range(UserCombiner):
    """The greatest message less the least."""

    def init(self):
        return None

    def step(self, part, to, message):
        m = float(message)
        return (m, m) if part is None else (min(part[0], m), max(part[1], m))

    def merge(self, part, other):
        return min(part[0], other[0]), max(part[1], other[1])

    def finish(self, part):
        return part[1] - part[0]


class RingReader(VertexReader):
    """A ring of n vertices, a range of them to a split."""

    def __init__(self, n: int):
        self.n = n

    def splits(self, hint: int) -> list:
        return [range(k, self.n, hint) for k in range(hint)]

    def read(self, split):
        for i in split:
            yield i, 10.0 * i, [((i + 1) % self.n, 100.0 * i)]


def squares_from(start: int):
    for i in range(start, start + 50):
        yield i, i * i


class EarlyTermination(ImperativeProgram):
    """Ends partitions by id mod 4: remainder 2 in superstep 1, remainder 3 in superstep 2."""

    value_type = "bigint"

    def compute(self, vertex: Vertex, messages: list) -> None:
        vertex.value = vertex.value or 0
        if vertex.superstep == 1:
            if vertex.id % 4 == 2:
                vertex.terminate_partition()
            else:
                vertex.value = 1
        elif vertex.superstep == 2:
            if vertex.id % 4 == 3:
                vertex.terminate_partition()
            else:
                vertex.value = 2
                vertex.vote_to_halt()


class CountMessages(VertexProgram):
    """Each vertex sends ``clones`` messages along every edge; the value is the number received.

    The clones are summed before the shuffle, so their number costs nothing.
    """

    state, message_type = {"value": "bigint"}, "bigint"

    def __init__(self, clones: int = 10_000):
        self.clones = clones

    def compute(self, ctx: Context) -> dict[str, Column]:
        return {"value": F.lit(0).cast("bigint") if ctx.superstep == 1 else F.coalesce("msg", F.lit(0).cast("bigint"))}

    def sends(self, ctx: Context) -> Column:
        return F.lit(ctx.superstep == 1)

    def message(self, ctx: Context) -> Column:
        return F.lit(self.clones)

    def halt(self, ctx: Context) -> Column:
        return F.lit(ctx.superstep > 1)


class GrowingText(ImperativeProgram):
    """State whose size changes every superstep; a vertex checks what it sent itself."""

    value_type = message_type = "string"

    def __init__(self, supersteps: int = 4):
        self.supersteps = supersteps

    def compute(self, vertex: Vertex, messages: list) -> None:
        if vertex.superstep > 1 and [len(m) for m in messages] != [len(vertex.value)]:
            raise AssertionError(f"vertex {vertex.id} lost its state")
        if vertex.superstep == self.supersteps:
            vertex.vote_to_halt()
            return
        vertex.value = "a" * (3 + (vertex.superstep * 37 + vertex.id) % 100)
        vertex.send(vertex.id, vertex.value)


class Failing(VertexProgram):
    """Raises at vertex 10."""

    def compute(self, ctx: Context) -> dict[str, Column]:
        return {"value": F.when(F.col("id") == 10, F.raise_error(F.lit("this vertex fails"))).otherwise(F.lit(1.0)).cast("double")}
