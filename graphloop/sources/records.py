"""Record sources: delimited files, labelled sparse vectors, and text records with multisets."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str | list[str], names: list[str], sep: str = "|") -> DataFrame:
    """All columns as text; a separator at the end of a line is allowed."""
    schema = ", ".join(f"`{n}` string" for n in [*names, "_end"])
    return spark.read.schema(schema).option("sep", sep).option("quote", "").option("mode", "PERMISSIVE").csv(path).drop("_end")


def parse_sparse(lines: DataFrame, value: str = "value") -> DataFrame:
    """(label, ids, vals) from ``label id:val id=val ...``, tokens between commas or spaces."""
    t = F.filter(F.split(F.col(value), r"[,\s]+"), lambda x: x != "")
    pairs = F.slice("_t", F.lit(2), F.size("_t"))
    rows = lines.select(t.alias("_t")).filter(F.size("_t") > 0)
    return rows.select(F.col("_t")[0].cast("int").alias("label"), F.transform(pairs, lambda x: F.split(x, "[:=]")[0].cast("int")).alias("ids"), F.transform(pairs, lambda x: F.split(x, "[:=]")[1].cast("float")).alias("vals"))


def read_labelled_sparse(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_sparse(spark.read.text(path))


#: Tokens of record text: strings, constructors of typed values, numbers with a type, brackets of multisets, all else.
_RECORD_TOKEN = re.compile(r"""
    "(?:[^"\\]|\\.)*"
  | (?P<make>[a-z][a-z0-9-]*)\s*\(\s*(?P<of>"(?:[^"\\]|\\.)*")\s*\)
  | (?P<number>-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?:i8|i16|i32|i64|f|d)?(?![\w.])
  | \{+ | \}+ | [\[\]] | [^"{}\[\]\d\sa-z-]+ | \s+ | [a-z]+ | .
""", re.X | re.S)


def record_to_json(line: str) -> str:
    """JSON of a record: multisets ``{{ }}`` are arrays; typed numbers and constructors (``datetime("...")``, ``int64("5")``)
    are plain values, and ``point("x,y")`` is an object of x and y. Strings stay as they are. Raises on unbalanced brackets."""
    out, held = [], []
    for m in _RECORD_TOKEN.finditer(line):
        token = m[0]
        if token[0] in "{[":  # a record begins with a name, so of a run of braces only the last can be one
            own = ["["] if token == "[" else ["{{"] * (len(token) // 2) + ["{"] * (len(token) % 2)
            held += own
            out += ["{" if x == "{" else "[" for x in own]
        elif token[0] in "}]":
            left = len(token)
            while left:
                top = held.pop() if held else ""
                left -= len(top)
                if left < 0 or top != ("[" if token == "]" else top.replace("[", "")) or not top:
                    raise ValueError(f"{token!r} closes nothing in {line[:80]!r}")
                out.append("}" if top == "{" else "]")
        elif m["make"]:
            text = json.loads(m["of"])
            if m["make"] == "point":
                x, y = text.split(",")
                out.append(json.dumps({"x": float(x), "y": float(y)}))
            else:
                out.append(text if m["make"] in ("int8", "int16", "int32", "int64", "float", "double", "boolean") else m["of"])
        else:
            out.append(m["number"] or token)
    if held:
        raise ValueError(f"{held[-1]!r} is never closed in {line[:80]!r}")
    return "".join(out)


def parse_records(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Rows of ``schema`` from record text: JSON with ``{{ ... }}`` for multisets, type suffixes such as ``5i64``, and
    constructors. Records nest; a field that the schema doesn't name is left out. A line that can't be parsed raises."""

    def strict(line: str) -> str:
        try:
            return record_to_json(line)
        except ValueError:
            return "{"  # which the parser rejects with the record's own error

    @F.pandas_udf("string")
    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in batches:
            yield lines.map(strict)

    return lines.filter(F.trim(value) != "").select(F.from_json(plain(F.col(value)), schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_records(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return parse_records(spark.read.text(path), schema)


@dataclass(frozen=True)
class FileSplit:
    """One of a comma list of ``[node:]path[?key=value&...]``: where it would best be read, its path and its options."""

    path: str
    node: str | None = None
    options: dict[str, str] = field(default_factory=dict)


def file_splits(text: str) -> list[FileSplit]:
    out = []
    for part in filter(None, map(str.strip, text.split(","))):
        path, _, options = part.partition("?")
        node, colon, rest = path.partition(":")
        named = colon and "/" not in node and not rest.startswith("//")
        pairs = dict(o.partition("=")[::2] for o in options.split("&") if o)
        out.append(FileSplit(rest if named else path, node if named else None, pairs))
    return out


def read_splits(spark: SparkSession, text: str) -> DataFrame:
    """(path, options, value): a row for each line of each split. Where a file is read is Spark's choice."""
    out = None
    for s in file_splits(text):
        made = F.create_map(*[F.lit(x) for kv in s.options.items() for x in kv]) if s.options else F.expr("cast(map() as map<string,string>)")
        own = spark.read.text(s.path).select(F.lit(s.path).alias("path"), made.alias("options"), "value")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no file is named")
    return out


def read_blocks(spark: SparkSession, path: str | list[str], size: int = 1 << 20) -> DataFrame:
    """(path, start, block): files as raw blocks of ``size`` bytes, not aligned to lines."""
    files = spark.read.format("binaryFile").load(path)
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("bigint")))
    return files.filter("length > 0").select("path", starts.alias("start"), "content").select("path", "start", F.substring("content", (F.col("start") + 1).cast("int"), F.lit(size)).alias("block"))
