"""Connected components of a graph given by its links, as alternating large-star and small-star steps.

Links stay distributed: each round is two aggregations over the links that are left, each written to the shared folder, and
the driver sees three numbers. Each is a query of its own: one plan of both repeats its inputs, and the driver plans and
describes the whole of it again after every shuffle. A node with many links is a hot key of the join with its least
neighbour. That join is salted: a link goes to one of ``SALTS`` tasks by its other end, and a node's least neighbour, one
row, to all of those; the aggregation itself is partial before its shuffle.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloop.llm.common import materialise, release

SALTS = 8


def _with_least(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The rows (u, v) of ``pairs`` with m, the least of u and its neighbours in ``of``."""
    least = of.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    spread = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = pairs.withColumn("_t", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, (F.col("u") == F.col("_u")) & (F.col("_t") == F.col("_s"))).select("u", "v", "m")


def _each(rows: DataFrame, *links: tuple[str, str]) -> DataFrame:
    """(u, v) for each of these pairs of columns of each row, read once."""
    return rows.select(F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in links])).alias("_l")).select("_l.u", "_l.v")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another; component is the least node that can be reached.

    Links of null nodes and of a node to itself are left out. No links give an empty result. The rounds end when one changes
    nothing, which is after a number that grows with the logarithm of the longest path. The result is a table for ``release``.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    e = materialise(e, "links")
    before = None
    for _ in count():
        large = _with_least(e.select(F.col("v").alias("u"), F.col("u").alias("v")), _each(e, ("u", "v"), ("v", "u")))
        large = materialise(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        release(e)
        # Small star: a node's lower neighbours all point to the least of them.
        small = _each(_with_least(large, large), ("v", "m"), ("u", "m")).filter("u <> v").distinct()
        e = materialise(small, "links")
        release(large)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == before:
            break
        before = now
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = materialise(ends, "components")
    release(e)
    return out
