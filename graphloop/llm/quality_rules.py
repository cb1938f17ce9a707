"""Quality rules as a learned decision list, evaluated by Spark's own expressions only.

Statistics of every whole text are built-in expressions. Sequential covering grows threshold conjunctions on two thirds
of a bounded sample of labelled statistics, prunes them on the rest, and emits one ordered conditional expression. The
sample (about ``SAMPLE`` rows, by a hash of the identifier) is the only thing that reaches the driver.

Repeated 5-word windows are told by their 64-bit xxHash within one text. Defined cases: a null or empty text has no words
and fails the base rule; a text under five words has no window; a null identifier is passed on; repeated rows give
repeated results; labels that are null, or of unknown documents, are ignored; without labels, or with labels of one class
only, the list is empty and every text that passes the base rule is kept; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloop.llm.common import SPACES, uniform

#: Rows of the fitting sample, thresholds tried for each statistic, most rules, most terms in a rule.
SAMPLE, THRESHOLDS, MAX_RULES, MAX_TERMS = 6000, 24, 12, 3
#: A rule must be right this often on both parts of the sample, so that clean texts stay.
PRECISION = 0.85
WINDOW = 5
_SPACE = "[ \t\n\x0b\x0c\r]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["word_length", "symbols_a_word", "dup_line_share", "repeat_share", "upper_share", "marks_a_word", "digit_share", "n_words"]


def _let(value: Column, body) -> Column:
    """Binds ``value`` once for ``body``, as a lambda's variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(hashes: Column) -> Column:
    """Words within windows found twice or more, from the windows' hashes in order."""

    def positions(s: Column) -> Column:
        same = lambda j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), (same(j + 1, x) | ((j > 0) & same(F.greatest(j - 1, F.lit(0)), x))).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"])

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("at"))
        return F.aggregate(p, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW).cast("long"), i - a["at"])).alias("n"), i.cast("long").alias("at")), lambda a: a["n"])

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(F.sort_array(_let(ordered, positions)), covered))


def statistics(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Rows of ``ident``, the base counts and the ratios that rules use."""
    t = F.col("_t")
    d = df.select(F.col(ident), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_trimmed", F.btrim(t, F.lit(SPACES)))
    d = d.withColumn("_w", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", _SPACE)))
    w, n = F.col("_w"), F.size("_w")
    window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    d = d.withColumn("_h", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    count = lambda what: F.regexp_count(t, F.lit(what)).cast("long")
    d = d.select(
        F.col(ident), n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), count("[#*$%&|<>]").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("_h")).alias("n_repeat_words"),
        F.size("_l").alias("_lines"), count("[A-Z]").alias("_upper"), count("[!?]").alias("_marks"), count("[0-9]").alias("_digits"),
    )
    per = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return d.withColumns({
        "word_length": per("word_chars", "n_words"), "symbols_a_word": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "_lines"), "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("_upper", "word_chars"), "marks_a_word": per("_marks", "n_words"), "digit_share": per("_digits", "word_chars"),
    }).drop("_lines", "_upper", "_marks", "_digits")


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Term, ...]


def learn(rows: list[tuple[list[float], bool]], names: list[str]) -> list[Rule]:
    """Rules for the rows marked bad, by sequential covering; sets of rows are integers with one bit a row."""
    if not rows or all(bad for _, bad in rows) or not any(bad for _, bad in rows):
        return []
    bad = sum(1 << i for i, (_, b) in enumerate(rows) if b)
    grow = sum(1 << i for i in range(len(rows)) if i % 3)
    prune = ((1 << len(rows)) - 1) & ~grow
    terms: list[tuple[Term, int]] = []
    for k, name in enumerate(names):
        values = sorted(v[k] for v, _ in rows)
        marked = sorted(v[k] for v, b in rows if b)
        cuts = {s[min(len(s) - 1, len(s) * q // THRESHOLDS)] for s in (values, marked) for q in range(THRESHOLDS)}
        # Half way to the values beside it, so that a rule doesn't hang on a value's last digit.
        after = dict(zip(distinct := sorted(set(values)), distinct[1:], strict=False))
        before = dict(zip(distinct[1:], distinct, strict=False))
        for cut in sorted({(c + beside.get(c, c)) / 2 for c in cuts for beside in (before, after)}):
            over = sum(1 << i for i, (v, _) in enumerate(rows) if v[k] > cut)
            under = ((1 << len(rows)) - 1) & ~over
            terms += [(Term(name, True, cut), over), (Term(name, False, cut), under)]

    def right(s: int) -> float:
        return ((s & bad).bit_count() + 1) / (s.bit_count() + 2)

    rules: list[Rule] = []
    left = (1 << len(rows)) - 1
    while len(rules) < MAX_RULES and (left & grow & bad).bit_count() >= 3:
        rule: list[tuple[Term, int]] = []
        cover = left
        while len(rule) < MAX_TERMS:
            # FOIL's gain: marked rows kept, times the rise of the log of their share
            before, best = log(right(cover & grow)), (0.0, None, 0)
            for term, rows_of in terms:
                s = cover & grow & rows_of
                gain = (s & bad).bit_count() * (log(right(s)) - before)
                if gain > best[0] + 1e-9:
                    best = gain, term, rows_of
            if best[1] is None:
                break
            rule.append((best[1], best[2]))
            cover &= best[2]
            if not (cover & grow & ~bad):
                break
        while len(rule) > 1:  # drop last terms for as long as the pruning part doesn't lose by it
            shorter = reduce(lambda a, x: a & x[1], rule[:-1], left)
            if right(shorter & prune) < right(cover & prune):
                break
            rule, cover = rule[:-1], shorter
        if not rule or right(cover & grow) < PRECISION or right(cover & prune) < PRECISION:
            break
        rules.append(tuple(t for t, _ in rule))
        left &= ~cover
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", quality: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Fits the list on about ``sample`` labelled rows; the sampled labels are few by that bound and are broadcast."""
    marked = labels.filter(F.col(quality).isNotNull() & F.col(ident).isNotNull()).select(F.col(ident).alias("_id"), (F.col(quality) == 0).alias("_bad"))
    n = marked.count()
    if not n:
        return []
    few = marked.filter(uniform(F.col("_id")) < sample / n)
    chosen = docs.join(F.broadcast(few), F.col(ident) == F.col("_id")).select(F.struct("_id", "_bad").alias("_of"), F.col(text).alias("_text"))
    got = statistics(chosen, "_text", "_of").select("_of._id", "_of._bad", *FEATURES).collect()
    got.sort(key=lambda r: (r[0], r[1], *r[2:]))
    return learn([([float(x) for x in r[2:]], bool(r[1])) for r in got], FEATURES)


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional: 0 where no rule holds, else the place of the first that does, from 1."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(reduce(lambda a, b: a & b, [t.column() for t in rules[k - 1]]), F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Rows of ``ident``, the base counts, base_failed, kept and the rule (as text) that rejected."""
    base_failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    d = statistics(docs, text, ident).withColumns({"base_failed": base_failed, "_rule": verdict(rules)})
    says = F.lit(None).cast("string")
    for k, rule in enumerate(rules, 1):
        says = F.when(F.col("_rule") == k, F.lit(" and ".join(map(str, rule)))).otherwise(says)
    return d.select(ident, *BASE, "base_failed", (~F.col("base_failed") & (F.col("_rule") == 0)).alias("kept"), says.alias("rule"))
