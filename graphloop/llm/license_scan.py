"""Licence scan: Aho-Corasick finds identifier tags and notice phrases; a shunting-yard parser evaluates SPDX expressions.

Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. A phrase is found where its words stand one after
the other, and so is the identifier tag, the words SPDX License Identifier in any spelling. From the place of its hit the
tag's expression is read, up to the end of the line: as far as licence identifiers, ``and``, ``or``, ``with`` and brackets go
and make a whole expression (``MIT and this file`` is ``MIT``). It adds the family of each licence it names; what can't be
parsed adds nothing. Identifiers are those of a known family, or spelt like one (``LicenseRef-x``, ``Foo-1.0``).

Defined cases: a null text counts as an empty one (no words, no labels, score 0); repeated rows give repeated results;
overlapping places all count; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloop.llm.common import prepare

BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl", "mozilla public license": "mpl", "eclipse public license": "epl", "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd", "isc license": "isc", "boost software license": "bsl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit", "creative commons attribution": "cc-by",
    "creative commons zero": "cc0", "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under the apache license": "apache", "all rights reserved": "proprietary", "python software foundation license": "psf",
    "european union public licence": "eupl", "zlib license": "zlib", "artistic license": "artistic",
}
#: Families of SPDX identifiers by their first letters, longest first when matched.
FAMILIES = {
    "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "gfdl": "gfdl", "apache": "apache", "mit": "mit", "bsd": "bsd", "0bsd": "bsd", "mpl": "mpl", "epl": "epl",
    "isc": "isc", "bsl": "bsl", "cc0": "cc0", "cc-by": "cc-by", "unlicense": "unlicense", "zlib": "zlib", "psf": "psf", "python": "psf", "eupl": "eupl", "artistic": "artistic",
}
PERMISSIVE = frozenset({"apache", "mit", "bsd", "isc", "bsl", "cc0", "unlicense", "zlib", "psf", "artistic", "cc-by"})
TAG = "spdx license identifier"
#: How far a label can be relied on, by what it comes from.
TRUST = {"tag": 0.95, "base": 0.8, "more": 0.7}
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+|\S")
#: How an identifier of no known family is spelt: with a number after a hyphen, or as a reference.
_LIKE_ONE = re.compile(r"(?:LicenseRef-|DocumentRef-)[A-Za-z0-9.:-]+|[A-Za-z][A-Za-z0-9.]*(?:-[A-Za-z0-9.]+)*-[0-9][A-Za-z0-9.]*\+?(?:-[A-Za-z]+)*")
_BIND = {"or": 1, "and": 2, "with": 3}
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class ExpressionError(ValueError):
    """A licence expression that can't be parsed."""


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: an SPDX expression in postfix order; ``with`` binds tighter than ``and``, that tighter than ``or``."""
    out: list[str] = []
    held: list[str] = []
    operand = False  # whether the last token closed an operand
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _BIND:
            if not operand:
                raise ExpressionError(f"operator {token!r} without a left side")
            while held and held[-1] != "(" and _BIND[held[-1]] >= _BIND[low]:
                out.append(held.pop())
            held.append(low)
            operand = False
        elif token == "(":
            if operand:
                raise ExpressionError("bracket after an operand")
            held.append(token)
        elif token == ")":
            if not operand:
                raise ExpressionError("bracket closed too early")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ExpressionError("bracket never opened")
            held.pop()
        elif operand:
            raise ExpressionError(f"{token!r} after an operand")
        elif re.fullmatch(r"[A-Za-z0-9.+:-]*[A-Za-z0-9][A-Za-z0-9.+:-]*", token):
            out.append(token)
            operand = True
        else:
            raise ExpressionError(f"{token!r} is no identifier")
    if not operand or "(" in held:
        raise ExpressionError("expression ends too early")
    return out + held[::-1]


def expression_of(line: str) -> str:
    """The longest beginning of a line that is a whole expression of licence identifiers; empty without one."""
    end, depth, operand, exception = 0, 0, False, False
    for m in _TOKEN.finditer(line):
        token, low = m[0], m[0].lower()
        if low in _BIND and operand:
            operand, exception = False, low == "with"
        elif token == "(" and not operand and not exception:
            depth += 1
        elif token == ")" and operand and depth:
            depth -= 1
        elif not operand and low not in _BIND and (family(token) or _LIKE_ONE.fullmatch(token) or exception and re.fullmatch(r"[A-Za-z0-9.+:-]*[A-Za-z0-9]", token)):
            operand = True
        else:
            break
        if operand and not depth:
            end = m.end()
    return line[:end]


def evaluate(expression: str, allowed: frozenset[str] | None = None) -> tuple[set[str], bool]:
    """The families that an expression names, and whether its terms can be met within the ``allowed`` families.

    ``or`` needs one side, ``and`` both; an exception after ``with`` leaves the licence's family as it is.
    """
    allowed = PERMISSIVE if allowed is None else allowed
    names: set[str] = set()
    stack: list[bool | str] = []

    def value(x: bool | str) -> bool:
        if isinstance(x, bool):
            return x
        name = family(x)
        if name:
            names.add(name)
        return name in allowed

    for token in to_postfix(expression):
        if token == "with":
            stack.pop()  # the exception
        elif token in _BIND:
            b, a = value(stack.pop()), value(stack.pop())
            stack.append(a or b if token == "or" else a and b)
        else:
            stack.append(token)
    return names, value(stack.pop())


def family(identifier: str) -> str | None:
    low = identifier.lower()
    found = [k for k in FAMILIES if low == k or low.startswith((k + "-", k + "+"))]
    return FAMILIES[max(found, key=len)] if found else None


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, label in {**MORE_PHRASES, **BASE_PHRASES, TAG: ""}.items():
        key = f" {phrase} "
        a.add_word(key, (len(key), label, "tag" if phrase == TAG else "base" if phrase in BASE_PHRASES else "more"))
    a.make_automaton()
    return a


@dataclass
class Scan:
    n_words: int = 0
    places: list[int] = field(default_factory=list)  # word positions of the base phrases
    base: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    expressions: list[str] = field(default_factory=list)
    permissive: bool | None = None
    score: float = 0.0


def _after(text: str, tags: list[int]) -> Iterator[str]:
    """What follows each tag on its line. tags: the places of their first words, in order."""
    if not tags:
        return
    raw = text.encode("utf-8", "surrogatepass")
    last = [t + TAG.count(" ") for t in tags]
    wanted = iter(last)
    want = next(wanted)
    for k, m in enumerate(_WORD.finditer(raw.translate(_CLEAN))):
        if k == want:
            end = raw.find(b"\n", m.end())
            line = raw[m.end() : len(raw) if end < 0 else end].decode("utf-8", "replace")
            yield line.lstrip(" \t\r:=\"'")
            want = next(wanted, None)
            if want is None:
                return


def scan_text(text: str | None) -> Scan:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()
    out = Scan(len(words))
    if not words:
        return out
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    trust: dict[str, float] = {}
    tags: list[int] = []
    at = word = 0
    for end, (size, label, kind) in sorted(automaton().iter(joined), key=lambda x: x[0] - x[1][0]):
        start = end - size + 1
        word, at = word + joined.count(" ", at, start), start
        if kind == "tag":
            tags.append(word)
            continue
        if kind == "base":
            out.places.append(word)
            out.base.add(label)
        trust[label] = max(trust.get(label, 0), TRUST[kind])
    for line in _after(text or "", tags):
        try:
            expression = expression_of(line)
            names, free = evaluate(expression)
        except ExpressionError:
            continue
        out.expressions.append(expression)
        out.permissive = free if out.permissive is None else out.permissive and free
        trust.update({x: TRUST["tag"] for x in names})
    out.labels = set(trust)
    miss = 1.0
    for x in trust.values():
        miss *= 1 - x
    out.score = 1 - miss if trust else 0.0
    return out


def scan_licences(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Rows of ``ident``, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive."""
    prepare(df.sparkSession)
    shape = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permissive boolean"

    @F.pandas_udf(shape)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [scan_text(t) for t in texts]
            yield pd.DataFrame({
                "n_words": [r.n_words for r in rows],
                "n_base": [len(r.places) for r in rows],
                "first_word": pd.array([min(r.places, default=None) for r in rows], dtype="Int64"),
                "last_word": pd.array([max(r.places, default=None) for r in rows], dtype="Int64"),
                "base_labels": [",".join(sorted(r.base)) for r in rows],
                "labels": [",".join(sorted(r.labels)) for r in rows],
                "score": [r.score for r in rows],
                "expressions": [" ; ".join(r.expressions) for r in rows],
                "permissive": pd.Series([r.permissive for r in rows], dtype=object),
            })

    return df.select(F.col(ident), scan(F.col(text)).alias("_scan")).select(ident, "_scan.*")
