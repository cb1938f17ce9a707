"""Scalar functions for preparing inputs and querying results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def switch_case(value: Column, *pairs: Column) -> Column:
    """``switch_case(x, a, ra, b, rb, ...)``: the result beside the first equal value, else null."""
    if len(pairs) % 2:
        raise ValueError("values and results come in pairs")
    out = F.lit(None)
    for when, then in reversed(list(zip(pairs[::2], pairs[1::2], strict=True))):
        out = F.when(value == when, then).otherwise(out)
    return out


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def circle(centre: Column, radius: Column) -> Column:
    return F.struct(centre.alias("centre"), radius.cast("double").alias("radius"))


def intersects(p: Column, c: Column) -> Column:
    """Whether a point lies in a circle, its edge included."""
    dx, dy = p["x"] - c["centre"]["x"], p["y"] - c["centre"]["y"]
    return dx * dx + dy * dy <= c["radius"] * c["radius"]


def milliseconds_between(a: Column, b: Column) -> Column:
    """The length of the interval between two timestamps, with a time zone or without."""
    return F.abs(F.unix_millis(a.cast("timestamp")) - F.unix_millis(b.cast("timestamp")))


def within(a: Column, b: Column, days: float = 1.0) -> Column:
    return milliseconds_between(a, b) <= F.lit(int(days * 86_400_000))
