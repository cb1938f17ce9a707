"""Substring dedup by hashing lines: the earliest ranked occurrence of a unit stays, the others go.

Units are the lines of a text and the sentences of its lines (up to and with a run of full stops, exclamation or question
marks). A line goes where an equal one came before, however short it is; a repeated paragraph is a run of such lines. What
is pasted into the middle of lines is no whole line, so sentences count as well, though not by themselves: a run of
neighbouring sentences that each came before goes if it has ``PASSAGE`` words or more. Units are normalised (lower case, white
space as one space, trimmed), told by kind and 128-bit digest, and brought together over the whole corpus by one shuffle.
Occurrences are ranked by identifier, then by their place in the text, then by a hash of the text. Offsets are code points
of the original text. Whatever goes has an occurrence that stays: the first of a sentence is never in a run, and not in a
line that goes, whose sentences came before as well.

Passages that begin or end inside a sentence lose their whole sentences only. Defined cases: a null or empty text has no
units; a null identifier ranks first, and its text is not cut (no row could be told from another); rows that repeat an
identifier are told apart by their texts, and equal ones are ranked alike, each losing the same spans; a text of repeated
lines only is emptied; identifiers can be of any type that can be ordered; an empty table gives an empty result; other
columns of the input are kept by ``remove``, under whatever name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloop.llm.common import prepare

#: Words that a run of repeated sentences needs.
PASSAGE = 25
LINE = re.compile(r"[^\n]*\n|[^\n]+")
SENTENCE = re.compile(r"[^.!?\n]*[.!?]+\n?|[^.!?\n]+\n?|\n")


def units_of(text: str | None) -> list[tuple[bool, int, int, int, int, str]]:
    """(whole line, place, start, end, words, normalised unit) of the units that have a word. Sentences are numbered from 0,
    and those without a word count, as parts of what stands before them; lines have the place -1."""
    out = []
    k = 0
    for line in LINE.finditer(text or ""):
        words = line[0].lower().split()
        if not words:
            continue
        at = line.start()
        out.append((True, -1, at, line.end(), len(words), " ".join(words)))
        for m in SENTENCE.finditer(line[0]):
            own = m[0].lower().split()
            if own:
                out.append((False, k, at + m.start(), at + m.end(), len(own), " ".join(own)))
                k += 1
    return out


def joined(units: list[tuple[bool, int, int, int, int]], passage: int) -> tuple[list[tuple[int, int]], int]:
    """(spans that go, joined where they touch, and the number of units in them) from a text's repeated units."""
    spans, run, n = [], [], 0
    sentences = sorted(u for u in units if not u[0])
    lines = [u for u in units if u[0]]
    for u, after in zip(sentences, [*sentences[1:], None], strict=True):
        run.append(u)
        if after is None or after[1] != u[1] + 1:
            if sum(x[4] for x in run) >= passage:
                spans += [(x[2], x[3]) for x in run]
            run = []
    spans += [(x[2], x[3]) for x in lines]
    out: list[list[int]] = []
    n = len(spans)
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out], n


def _units(df: DataFrame, text: str, ident: str) -> DataFrame:
    """(id, text_hash, line, place, start, end, words, digest) of every unit."""
    prepare(df.sparkSession)
    kind = df.schema[ident].dataType.simpleString()
    names = ["id", "text_hash", "line", "place", "start", "end", "words", "digest"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            types = [batch.column(0).type, pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            out: list[tuple] = []
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for whole, k, start, end, n, unit in units_of(t.as_py()):
                    out.append((i, h, whole, k, start, end, n, xxh3_128_digest(unit.encode("utf-8", "surrogatepass"), int(whole))))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True) if out else [[]] * 8, types, strict=True)], names)

    return df.select(F.col(ident), F.xxhash64(F.col(text)), F.col(text)).mapInArrow(cut, f"id {kind}, text_hash long, line boolean, place int, start int, end int, words int, digest binary")


def _lost(df: DataFrame, text: str, ident: str, passage: int) -> DataFrame:
    """(id, text_hash, cut: n_units and spans, first_ids) of the texts that lose something."""
    units = _units(df, text, ident)
    place = F.struct("id", "start", "text_hash")
    # A window, and no join with an aggregate: units are made and shuffled once.
    again = units.withColumn("first", F.min(place).over(Window.partitionBy("digest"))).filter((place != F.col("first")) & F.col("id").isNotNull())
    own = F.struct("line", "place", "start", "end", "words")
    # Equal rows have equal units: the set counts each once.
    lost = again.groupBy("id", "text_hash").agg(F.collect_set(F.struct(own.alias("unit"), F.col("first.id").alias("first"))).alias("units"))

    @F.pandas_udf("n_units long, spans array<struct<start:int,end:int>>, used array<int>")
    def merged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for units in texts:
                spans, n = joined([tuple(u.values()) for u in units], passage)
                used = [k for k, u in enumerate(units) if any(s <= u["start"] and u["end"] <= e for s, e in spans)] if spans else []
                rows.append((n, [{"start": s, "end": e} for s, e in spans], used))
            yield pd.DataFrame(rows, columns=["n_units", "spans", "used"])

    once = merged.asNondeterministic()  # else the filter has a call of its own
    cut = lost.select("id", "text_hash", "units", once(F.transform("units", lambda u: u["unit"])).alias("cut")).filter(F.col("cut.n_units") > 0)
    firsts = F.array_sort(F.array_distinct(F.transform("cut.used", lambda k: F.get("units", k)["first"])))
    return cut.select("id", "text_hash", F.col("cut.n_units").alias("n_units"), F.col("cut.spans").alias("spans"), firsts.alias("first_ids"))


def repeats(df: DataFrame, text: str = "text", ident: str = "doc_id", passage: int = PASSAGE) -> DataFrame:
    """A row for each text that loses something: ``ident``, n_units and n_chars removed, spans, and first_ids.

    spans: array of (start, end) that are removed, in order, neighbours joined; first_ids: the distinct identifiers of the
    documents that keep the earliest occurrences of what goes, sorted.
    """
    chars = F.aggregate("spans", F.lit(0).cast("long"), lambda a, u: a + u["end"] - u["start"])
    return _lost(df, text, ident, passage).select(F.col("id").alias(ident), "n_units", chars.alias("n_chars"), "spans", "first_ids")


def cut(text: str, spans: list) -> str:
    """``text`` without ``spans``."""
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return "".join([*out, text[at:]])


def removed(df: DataFrame, text: str = "text", ident: str = "doc_id", passage: int = PASSAGE) -> DataFrame:
    """Columns row (the row of ``df`` as it is), left (its text without what goes), n_units, spans and first_ids (null: nothing
    goes). Within structs no name clashes."""
    prepare(df.sparkSession)

    @F.pandas_udf("string")
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([t if t is None or s is None else cut(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    lost = _lost(df, text, ident, passage).select(F.struct("id", "text_hash").alias("_key"), F.struct("n_units", "spans", "first_ids").alias("_lost"))
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.struct(F.col(ident).alias("id"), F.xxhash64(F.col(text)).alias("text_hash")).alias("_of"))
    both = keyed.join(lost, F.col("_of") == F.col("_key"), "left")
    whole: Column = F.col("row").getField(text)
    left = F.when(F.col("_lost").isNull(), whole).otherwise(without(whole, F.col("_lost.spans")))
    return both.select("row", left.alias("left"), "_lost.n_units", "_lost.spans", "_lost.first_ids")


def remove(df: DataFrame, text: str = "text", ident: str = "doc_id", passage: int = PASSAGE, spans: str | None = "removed_spans") -> DataFrame:
    """``df`` with repeated units cut from ``text``; the column ``spans`` holds the original offsets of what went (null:
    nothing). It takes the place of a column of that name; None leaves it out."""
    out = removed(df, text, ident, passage)
    own = [F.col("left").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns if c != spans]
    return out.select(*own, *([F.col("spans").alias(spans)] if spans else []))
