"""URL filter: allow and block rules first, else a logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled URL table: the file ``labelled_urls.csv`` beside this module (some
200 rows), or a caller's own rows of at most ``MAX_LABELLED``. Its columns are label (1 to block, 0 to keep), by (what the
label is for, the host or the path) and url. A host that is labelled has the same label under other paths, so ``seed`` gives
each such row's name in several neutral surroundings, which leaves the name as what tells. Weights have a fixed size (2^``BITS`` floats)
and travel with the function.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule, and is allowed; URLs of any length
are read whole; repeated rows give repeated results; an empty table gives an empty result; among rules of one length the
first in order wins; other columns of the input are ignored.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from pathlib import Path
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloop.llm.common import ascii_lower, prepare

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
BITS, SIZES, MAX_LABELLED = 16, (2, 3, 4, 5), 100_000

LABELLED = Path(__file__).with_name("labelled_urls.csv")
#: What says nothing and is put around labelled names: paths after, labels before, and domains instead of a host's own.
NEUTRAL, BEFORE = ("", "/", "/en/12", "/de/345?page=2", "/fr/678.html", "/article/2019/05/item", "/index.html"), ("", "www.", "m.", "blog.")
DOMAINS = (None, "com", "net", "org", "info", "example.com", "example.net", "co.uk", "example.org")
#: Probability from which a URL is blocked: about where names held out of training are told best.
THRESHOLD = 0.45
#: Frequent pairs of letters, of which names that mean nothing are made, and how many of those are kept as allowed.
PAIRS, MADE_UP = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(), 300


def seed(path: Path | str = LABELLED) -> list[tuple[str, int]]:
    """The labelled URL table, (url, 1 to block or 0 to keep), with labelled names in neutral surroundings as well.

    Names that mean nothing are added as allowed, for a name is blocked for what it says and not for being unknown.
    """
    draw, out = Random(11), []

    def around(scheme: str, name: str, own: str, n: int) -> list[str]:
        return [f"{scheme}://{draw.choice(BEFORE)}{name}.{draw.choice(DOMAINS) or own}{draw.choice(NEUTRAL)}" for _ in range(n)]

    with open(path, newline="", encoding="utf-8") as f:
        for row in csv.DictReader(f):
            url, label = row["url"], int(row["label"])
            out.append((url, label))
            if row["by"] == "host":
                scheme, _, rest = url.partition("://")
                name, _, own = rest.partition("/")[0].removeprefix("www.").partition(".")
                out += [(u, label) for u in around(scheme, name, own, 8)]
    for _ in range(MADE_UP):
        out += [(u, 0) for u in around("https", "".join(draw.choice(PAIRS) for _ in range(draw.randint(2, 5))), "com", 2)]
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def split_url(url: str | None) -> tuple[str, str]:
    """As ``parts``, for one URL on the driver."""
    from re import match

    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = match(r"([^/?#]*)([^?#]*)", rest)
    return m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    chosen = verdict = F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: -len(r[1]))[::-1]:
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        chosen, verdict = F.when(fits, F.lit(rule)).otherwise(chosen), F.when(fits, F.lit(action)).otherwise(verdict)
    return chosen, verdict


def features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed column of every character n-gram of the batch; digits are all alike; host and path are told apart."""
    cleaned = [f"\x02{h}\x03\x04{p}\x05" for h, p in zip(hosts, paths, strict=True)]
    raw = [x.encode("utf-8", "surrogatepass") for x in cleaned]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    flat[(flat >= 48) & (flat <= 57)] = 48
    row = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    is_path = np.concatenate([np.arange(len(x)) > x.index(b"\x04") - 1 for x in raw]) if raw else np.zeros(0, bool)
    rows, cols = [], []
    for n in SIZES:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ flat[k : k + m]) * np.uint32(16777619)
        inside = (row[:m] == row[n - 1 :]) & (is_path[:m] == is_path[n - 1 :])
        h = (h ^ (is_path[:m] * np.uint32(0x9E3779B9))) * np.uint32(2654435761)
        rows.append(row[:m][inside])
        cols.append((h >> np.uint32(32 - BITS))[inside])
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, int), np.zeros(0, np.uint32))


def probabilities(weights: np.ndarray, bias: float, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    rows, cols = features(hosts, paths)
    n = len(hosts)
    size = np.maximum(np.bincount(rows, minlength=n), 1)
    return 1 / (1 + np.exp(-(np.bincount(rows, weights[cols], minlength=n) / np.sqrt(size) + bias)))


def train(labelled: Sequence[tuple[str, int]], steps: int = 500, rate: float = 2.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression by full gradient steps; the same rows give the same weights."""
    if not labelled or len(labelled) > MAX_LABELLED:
        raise ValueError(f"a labelled URL table of 1 to {MAX_LABELLED} rows is needed, not {len(labelled)}")
    split = [split_url(u) for u, _ in labelled]
    y = np.array([v for _, v in labelled], float)
    rows, cols = features(*zip(*split, strict=True))
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both classes weigh alike
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(rows, w[cols], minlength=len(y)) * scale + b)))
        g = (p - y) * each
        w -= rate * (np.bincount(cols, (g * scale)[rows], minlength=len(w)) + decay * w) * 10
        b -= rate * g.sum()
    return w, b


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None, threshold: float = THRESHOLD, url: str = "url", ident: str = "page_id") -> DataFrame:
    """Rows of ``ident``, host, path, rule, verdict (allow or block) and score (the model's probability of block)."""
    prepare(df.sparkSession)
    weights, bias = train(seed() if labelled is None else labelled)
    weights = weights.astype(np.float32)

    @F.pandas_udf("double")
    def blocked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series(probabilities(weights, bias, hosts.tolist(), paths.tolist()))

    host, path = parts(F.col(url))
    split = df.select(F.col(ident), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = split.select(ident, "host", "path", rule.alias("rule"), verdict.alias("_by_rule"), blocked("host", "path").alias("score"))
    by_model = F.when((F.col("host") != "") & (F.col("score") >= threshold), "block").otherwise("allow")
    return scored.select(ident, "host", "path", "rule", F.coalesce("_by_rule", by_model).alias("verdict"), "score")


