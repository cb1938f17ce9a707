"""Relational operators around graph jobs: key joins, time-distance joins, top-k, utilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloop.functions import milliseconds_between


def key_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", hint: str | None = None) -> DataFrame:
    """A join by key; ``hint`` (merge, shuffle_hash, shuffle_replicate_nl) asks for a strategy."""
    return left.join(right.hint(hint) if hint else right, on, how)


def key_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct keys of both sides."""
    return a.select(key).union(b.select(key)).distinct()


def time_distance_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, millis: int) -> DataFrame:
    """Pairs of equal ``key`` whose times are within ``millis``; both sides' other columns must differ in name.

    Times fall into bins of that width and meet in their own and the neighbouring bins, so a key with many rows is dealt
    over its bins instead of being compared whole.
    """
    bin_of = lambda c: F.floor(F.unix_millis(F.col(c).cast("timestamp")) / F.lit(millis))
    near = left.withColumn("_bin", F.explode(F.array(*[bin_of(left_time) + d for d in (-1, 0, 1)])))
    other = right.withColumns({"_bin2": bin_of(right_time)}).withColumnRenamed(key, "_key2")
    on = (F.col(key) == F.col("_key2")) & (F.col("_bin") == F.col("_bin2"))
    return near.join(other, on).filter(milliseconds_between(F.col(left_time), F.col(right_time)) <= millis).drop("_bin", "_bin2", "_key2")


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def find_largest(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("largest"))


def groups_of_at_least(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, n) of groups with n rows or more."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= n)


def neighbours_together(df: DataFrame, n: int) -> DataFrame:
    """At most n partitions, each of neighbouring ones of before, without a shuffle."""
    return df.coalesce(n)
