"""Mixing sources to target weights by iterative proportional fitting (raking).

Token masses are summed over source, language and topic strata; raking scales each cell until the marginals meet their
targets; documents are then sampled with the calibrated probability of their cell. A caller names strata and weights, and
``other`` stands for the rest (nulls included), so the number of cells is bounded by the targets. Without targets,
``targets_of`` takes them from the corpus: each source, language and topic by the power ``EVEN`` of its own mass, so that
large ones lead and small ones aren't lost. Then there is a cell for every combination of these that occurs; only
these sums reach the driver. A probability can't exceed 1, so raking is bounded: full cells stay full and the others make up
for them as far as they can. It ends when a round changes no probability by more than ``CLOSE``.

Topics are told by words of law, technology, commerce, contact and news that a text holds, the first that fits in that order,
or else ``general`` (``TOPIC_WORDS``, in any language that uses them); a caller can pass words of their own.
Defined cases: a null text has no tokens; a document without tokens is drawn by its cell's probability like any other and
adds nothing to a mass; a null identifier is drawn as the text "null"; rows that repeat an identifier are drawn alike; a
stratum with a target but no mass is left out and its target shared by the others; an empty table gives an empty result;
columns of any name are kept by ``sample``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloop.llm.common import SPACES, ascii_lower, materialise, uniform

OTHER, GENERAL = "other", "general"
#: Most rounds of raking, the change under which it ends, the power of a stratum's own mass, the share of tokens to keep.
ROUNDS, CLOSE, EVEN, BUDGET = 1000, 1e-9, 0.7, 0.5
TOPIC_WORDS = {
    "law": ("license", "licence", "copyright", "all rights reserved", "lizenz", "licencia", "court", "contract"),
    "technology": ("password", "api_key", "secret", "token", "function", "import ", "software", "server", "http://", "https://"),
    "commerce": ("$", "€", "price", "invoice", "subscribe", "discount", "iban", "credit card"),
    "contact": ("@", "phone", "e-mail", "email", "tel.", "address"),
    "news": ("reported", "minister", "president", "government", "reuters", "police"),
}


@dataclass(frozen=True)
class Targets:
    """Weights of each dimension's strata (they need not sum to one), and the share of all tokens that the mixture has."""

    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float] = field(default_factory=lambda: dict.fromkeys([*TOPIC_WORDS, GENERAL], 1.0))
    budget: float = BUDGET


def tokens_of(text: Column) -> Column:
    """Words between ASCII white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.regexp_count(trimmed, F.lit("[ \t\n\x0b\x0c\r]+")) + 1).cast("long")


def topic_of(text: Column, words: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The first topic of which the text holds a word, letters A-Z lower-cased; else ``general``."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    # One lower-cased copy serves all searches.
    chosen = F.lit(GENERAL)

    def pick(t: Column) -> Column:
        out = chosen
        for topic, own in reversed((TOPIC_WORDS if words is None else words).items()):
            fits = F.lit(False)
            for w in own:
                fits = fits | t.contains(w)
            out = F.when(fits, topic).otherwise(out)
        return out

    return F.get(F.transform(F.array(low), pick), F.lit(0))


def stratum(c: Column, named: dict[str, float] | None) -> Column:
    """The stratum of ``c``; every value is one of its own without names."""
    if named is None:
        return F.coalesce(c, F.lit(OTHER))
    return F.when(c.isin(*[k for k in named if k != OTHER]), c).otherwise(F.lit(OTHER))


Cell = tuple[str, str, str]


def targets_of(mass: dict[Cell, float], even: float = EVEN, budget: float = BUDGET) -> Targets:
    """Targets from the corpus: each stratum by the power ``even`` of its mass."""
    sums: list[dict[str, float]] = [{}, {}, {}]
    for cell, m in sorted(mass.items()):
        for own, k in zip(sums, cell, strict=True):
            own[k] = own.get(k, 0.0) + (m or 0)
    return Targets(*({k: m**even for k, m in own.items()} for own in sums), budget)


def rake(mass: dict[Cell, float], targets: Targets, rounds: int = ROUNDS, close: float = CLOSE) -> dict[Cell, float]:
    """The probability of each cell. mass: tokens by cell."""
    cells = {c: float(m) for c, m in sorted(mass.items()) if m and m > 0}
    budget = targets.budget * sum(cells.values())
    p = dict.fromkeys(cells, min(1.0, targets.budget))
    for _ in range(rounds):
        before = dict(p)
        for d, named in enumerate((targets.source, targets.lang, targets.topic)):
            have: dict[str, float] = {}
            for c, m in cells.items():
                have[c[d]] = have.get(c[d], 0.0) + m * p[c]
            whole = sum(named.get(k, 0.0) for k in have)
            for c in cells:
                want = budget * named.get(c[d], 0.0) / whole if whole else 0.0
                p[c] = min(1.0, p[c] * want / have[c[d]]) if have[c[d]] > 0 else 0.0
        if all(abs(p[c] - before[c]) <= close for c in p):
            break
    return p


def strata(df: DataFrame, targets: Targets | None = None, text: str = "text", ident: str = "doc_id", source: str = "source", lang: str = "lang") -> DataFrame:
    """Rows of ``ident``, n_tokens and the strata source, lang and topic."""
    of = (None, None) if targets is None else (targets.source, targets.lang)
    topic = topic_of(F.col(text)) if targets is None else stratum(topic_of(F.col(text)), targets.topic)
    return df.select(F.col(ident), tokens_of(F.col(text)).alias("n_tokens"), stratum(F.col(source).cast("string"), of[0]).alias("source"), stratum(F.col(lang).cast("string"), of[1]).alias("lang"), topic.alias("topic"))


def probabilities(rows: DataFrame, targets: Targets | None = None) -> dict[Cell, float]:
    """Calibrated probabilities from the strata of all rows."""
    sums = rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("m")).collect()
    mass = {(r[0], r[1], r[2]): r[3] for r in sums}
    return rake(mass, targets_of(mass) if targets is None else targets)


def chance(p: dict[Cell, float]) -> Column:
    """The probability of a row's cell, as a literal map; cells without mass have the probability of no tokens, 0."""
    if not p:
        return F.lit(0.0)
    pairs = [x for c, v in p.items() for x in (F.lit("\x1f".join(c)), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("\x1f", "source", "lang", "topic")), F.lit(0.0))


def mix(df: DataFrame, targets: Targets | None = None, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Rows of ``ident``, source, lang, topic, n_tokens, probability and kept, from a table in the shared folder."""
    rows = materialise(strata(df, targets, text, ident), "strata")
    drawn = rows.withColumn("probability", chance(probabilities(rows, targets)))
    out = drawn.withColumn("kept", uniform(F.coalesce(F.col(ident).cast("string"), F.lit("null"))) < F.col("probability"))
    out._scratch_path = rows._scratch_path  # for release
    return out


def sample(df: DataFrame, targets: Targets | None = None, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that are drawn, with all their columns; nothing is shuffled but the sums."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    cell = strata(whole.select("_row", F.col(f"_row.{text}").alias("t"), "_row.source", "_row.lang"), targets, "t", "_row")
    p = chance(probabilities(cell, targets))
    return cell.filter(uniform(F.coalesce(F.col(f"_row.{ident}").cast("string"), F.lit("null"))) < p).select("_row.*")
