"""Language identification by error-correcting output codes.

Each learned language has a codeword; a logistic classifier on hashed byte n-grams predicts each bit; loss-weighted
decoding picks the language whose codeword has the least weighted logistic loss and flags texts where two languages come
close. Every language that is labelled is learned. Fitting uses a bounded sample of the labelled rows (about ``SAMPLE`` rows,
or ``EACH`` a language where that is more, drawn by a hash of the identifier); prediction reads every whole text, in chunks of ``CHUNK`` bytes that share their edges.

Defined cases: a null text or one without a letter is ``und`` with score 0 and not ambiguous; without any labelled row
every text is ``und``; with one language every text with a letter is of that language; repeated rows give repeated
results; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloop.llm.common import prepare, uniform

#: Rows of the fitting sample, and least rows of a language there; hashed columns (a power of two), bytes of a chunk.
SAMPLE, EACH, COLUMNS_LOG2, CHUNK = 3000, 20, 12, 1 << 20
ORDERS = (2, 3, 4)
#: A text is ambiguous when the second language's probability is over this share of the first's.
AMBIGUOUS = 0.8
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counts(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams of the whole text; ASCII is lower-cased, a run of what is no letter there is one space."""
    raw = b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_FOLD).split()) + b" "
    out = np.zeros(1 << COLUMNS_LOG2, np.int64)
    shift, edge = np.uint32(32 - COLUMNS_LOG2), max(ORDERS) - 1
    for at in range(0, len(raw), CHUNK):
        b = np.frombuffer(raw, np.uint8, min(CHUNK + edge, len(raw) - at), at).astype(np.uint32)
        h = b
        for n in range(2, max(ORDERS) + 1):
            last = b[n - 1 :]
            h = h[: len(last)] * np.uint32(257) + last
            if n in ORDERS:
                own = h[:CHUNK]
                out += np.bincount(((own + np.uint32(n * 0x9E37)) * np.uint32(2654435761)) >> shift, minlength=len(out))
    return out


def feature(text: str) -> np.ndarray:
    c = counts(text)
    return np.sqrt(c / max(1, c.sum())).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """An n x bits matrix of +1 and -1: exhaustive codes up to 7 languages, else random dense codes of the best distance."""
    if n <= 1:
        return np.zeros((n, 0))
    if n <= 7:
        return np.array([[1 if (b | 1 << (n - 1)) >> (n - 1 - i) & 1 else -1 for b in range(2 ** (n - 1) - 1)] for i in range(n)], float)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, found = -1, np.zeros((n, bits))
    for _ in range(60):
        m = rng.choice([-1.0, 1.0], (n, bits))
        apart = ((bits - m @ m.T) / 2 + np.eye(n) * bits).min()
        if apart > best and (np.abs(m.sum(0)) < n).all():
            best, found = apart, m
    return found


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # columns x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the chosen language, its probability, and that of the second, for each row of features."""
        if len(self.languages) < 2:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x))
        margin = x @ self.weights + self.bias
        # A bit costs log(1 + exp(-margin)) where the codeword has +1, and log(1 + exp(margin)) where it has -1.
        loss = np.logaddexp(0, -margin) @ ((self.code > 0) * self.trust).T + np.logaddexp(0, margin) @ ((self.code < 0) * self.trust).T
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        rows = np.arange(len(x))
        return order[:, 0], p[rows, order[:, 0]], p[rows, order[:, 1]]


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 250) -> Model:
    """Bit classifiers by Adam over full steps; a fifth of the rows is set aside to weigh the bits."""
    code = codewords(len(languages))
    bits = code.shape[1]
    if not bits:
        return Model(languages, code, np.zeros((x.shape[1], 0)), np.zeros(0), np.zeros(0))
    aside = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    target = code[y].astype(np.float32)
    share = np.bincount(y, minlength=len(languages))
    each = (1 / np.maximum(share, 1))[y].astype(np.float32)
    train, goal, each = x[~aside], target[~aside], each[~aside] / each[~aside].sum()
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = -goal / (1 + np.exp(np.clip(goal * (train @ w + b), -30, 30))) * each[:, None]
        d = train.T @ g + 1e-6 * w
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= 0.5 * g.sum(0)
    held, truth = (x[aside], target[aside]) if aside.any() else (x, target)
    right = (np.sign(held @ w + b) == truth).mean(0)
    trust = np.maximum(right - 0.5, 0.01)
    return Model(languages, code, w, b, trust / trust.sum() * bits / 2)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", ident: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fits a model on about ``sample`` rows of ``labelled``; every language gets an even share, rare ones all their rows.

    The languages themselves, and how often each is there, come to the driver.
    """
    prepare(labelled.sparkSession)
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect())
    if not sizes:
        return Model([], codewords(0), np.zeros((1 << COLUMNS_LOG2, 0)), np.zeros(0), np.zeros(0))
    share = max(sample / len(sizes), EACH)
    chances = F.create_map(*[x for name, n in sizes for x in (F.lit(name), F.lit(share / n))])
    chance = F.coalesce(F.try_element_at(chances, F.col(lang)), F.lit(0.0))

    @F.pandas_udf("binary")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([feature(t).astype(np.float16).tobytes() for t in texts])

    got = rows.filter(uniform(F.coalesce(F.col(ident).cast("string"), F.md5(text))) < chance).select(F.col(lang).alias("l"), F.xxhash64(F.col(ident)).alias("k"), features(text).alias("f")).collect()
    got.sort(key=lambda r: (r["k"], r["l"], r["f"]))
    names = [name for name, _ in sizes if any(r["l"] == name for r in got)]
    place = {name: i for i, name in enumerate(names)}
    x = np.array([np.frombuffer(r["f"], np.float16) for r in got], np.float32).reshape(len(got), -1)
    return fit(x, np.array([place[r["l"]] for r in got], int), names)


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[Column | str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default) with lang_pred, score and ambiguous."""
    prepare(df.sparkSession)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            known = [bool(model.languages and t and any(map(str.isalpha, t))) for t in texts]
            lang, score, second = np.array(["und"] * len(known), object), np.zeros(len(known)), np.zeros(len(known))
            if any(known):
                best, p, q = model.decode(np.array([feature(t) for t, k in zip(texts, known, strict=True) if k]))
                lang[known], score[known], second[known] = np.array(model.languages, object)[best], p, q
            yield pd.DataFrame({"lang_pred": lang, "score": score, "ambiguous": second > AMBIGUOUS * score})

    return df.select(*(keep or ["doc_id"]), judge(F.col(text)).alias("_lang")).select("*", "_lang.*").drop("_lang")
