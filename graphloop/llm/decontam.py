"""Benchmark decontamination: a BM25 inverted index of the test items, queried with every training passage by block-max WAND.

Items are indexed with BM25 impacts, each divided by the item's score against itself, so a passage's score is the share of
the item that it matches, and one threshold fits all items. A passage is a window of twice the longest item's length (at
least ``WINDOW`` words) and starts every half window, so each item that a text holds lies whole in some passage.

Passages of a text are first held against a bound, many at once: of every item the weakest terms, ``SLACK`` of it together,
are taken as matched, and the postings of the others, which are the rarer and shorter ones, are added up. Only a passage
that could reach the threshold with some item goes on to the search. There each term has a cursor over its postings, in
blocks of ``BLOCK`` with their greatest impact: the pivot is the first item that the terms' greatest impacts allow, the
blocks around it must allow it as well, else the cursors skip to the end of the nearest block, and what remains is scored.
Retrieved pairs are verified on word shingles: five words of the question, and those of the answer, must be found in the
passage to the shares that are asked.

Document frequencies, lengths and the window are counted once over the whole benchmark. The index travels to the executors
as long as it has ``PART`` postings or fewer, in one piece, and documents are read once; a larger benchmark is cut into parts
of that size with a pass each, which changes no row, as a part has the statistics of the whole. Texts are searched in slices
of passages, as many as keep a table of passages by terms or items within ``SLICE`` cells (one at least), so memory doesn't
grow with their length. An item's answer is what follows its last question
mark, or else its last sentence; an item of one sentence is all question.

Defined cases: null or empty texts and items match nothing; items shorter than a shingle are one shingle; identical items
are all reported; rows that repeat an identifier are judged one by one and reported once; identifiers can be of any type; an
empty table on either side gives an empty result; other columns of the inputs are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import fsum, log
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloop.llm.common import prepare

K1, B = 1.2, 0.75
THRESHOLD, QUESTION, ANSWER = 0.7, 0.5, 0.5
SHINGLE, WINDOW, BLOCK, SLACK, SLICE, PART = 5, 64, 8, 0.2, 4_000_000, 4_000_000
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SENTENCE = re.compile(r"[^.!?]*[.!?]+|[^.!?]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    at = text.rfind("?") + 1
    if at and words_of(text[at:]):
        return words_of(text[:at]), words_of(text[at:])
    sentences = [s for s in _SENTENCE.findall(text) if words_of(s)]
    if len(sentences) < 2:
        return words_of(text), []
    return words_of("".join(sentences[:-1])), words_of(sentences[-1])


def parts_of(text: str) -> list[tuple[int, set[bytes]]]:
    """(shingle length, shingles) of the question and of the answer.

    A part under ``SHINGLE`` words takes in the words beside it; an item under ``SHINGLE`` words is compared as one shingle
    of its own length.
    """
    question, answer = question_and_answer(text)
    whole = question + answer
    if len(question) < SHINGLE:
        question = whole[:SHINGLE]
    if answer and len(answer) < SHINGLE:
        answer = whole[-SHINGLE:]
    return [(n := min(SHINGLE, len(part)), shingles(part, n)) for part in (question, answer)]


def shingles(words: list[bytes], n: int = SHINGLE) -> set[bytes]:
    """The distinct runs of ``n`` words; none of no words."""
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Statistics:
    """What BM25 needs to know of the whole benchmark: items with words, items by word, words in all, words of the longest."""

    items: int = 0
    seen: Counter = field(default_factory=Counter)
    words: int = 0
    longest: int = 0

    def add(self, text: str | None) -> int:
        """Counts one item; the number of its distinct words."""
        words = words_of(text)
        if words:
            self.items += 1
            self.seen.update(set(words))
            self.words += len(words)
            self.longest = max(self.longest, len(words))
        return len(set(words))

    def impacts(self, words: list[bytes]) -> dict[bytes, float]:
        """BM25 of each word of an item, divided by the sum."""
        mean = self.words / max(1, self.items)
        raw = {}
        for w, f in Counter(words).items():
            idf = log(1 + (self.items - self.seen[w] + 0.5) / (self.seen[w] + 0.5))
            raw[w] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean))
        whole = fsum(raw.values())
        return {w: x / whole for w, x in raw.items()}


class Cursor:
    """A place in the postings of a term: items in order, with impacts; blocks with their last item and greatest impact."""

    __slots__ = ("at", "block", "doc", "impacts", "items", "lasts", "most", "tops")

    def __init__(self, postings: tuple[list[int], list[float], list[int], list[float], float]):
        self.items, self.impacts, self.lasts, self.tops, self.most = postings
        self.at = self.block = 0
        self.doc = self.items[0]

    def seek(self, doc: int) -> bool:
        """Goes to the first posting at or after ``doc``, past whole blocks first; False at the end."""
        if not self.shallow(doc):
            return False
        at, items = max(self.at, self.block * BLOCK), self.items
        while items[at] < doc:
            at += 1
        self.at, self.doc = at, items[at]
        return True

    def shallow(self, doc: int) -> bool:
        """Goes to the block that could hold ``doc``, without a look at its postings."""
        block, lasts = self.block, self.lasts
        while block < len(lasts) and lasts[block] < doc:
            block += 1
        self.block = block
        return block < len(lasts)


class Index:
    """Postings of test items. statistics: of the benchmark that the items are from; by default they are all of it."""

    def __init__(self, items: list[tuple[Any, str]], statistics: Statistics | None = None, threshold: float = THRESHOLD):
        if statistics is None:
            statistics = Statistics()
            for _, t in items:
                statistics.add(t)
        items = [(i, t) for i, t in items if words_of(t)]
        # Items with alike terms stand together, which makes the bounds of blocks tight.
        bag = {k: words_of(t) for k, (_, t) in enumerate(items)}
        order = sorted(bag, key=lambda k: (sorted(set(bag[k]), key=lambda w: (-statistics.seen[w], w))[:3], str(items[k])))
        self.ids = [items[k][0] for k in order]
        self.parts = [parts_of(items[k][1]) for k in order]
        self.threshold = threshold
        self.half = max(WINDOW, statistics.longest)
        self.term = {w: t for t, w in enumerate(sorted({w for words in bag.values() for w in words}))}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.term]
        strong: list[list[tuple[int, float]]] = [[] for _ in self.term]
        self.granted = np.zeros(len(order))  # what an item's weak terms make together
        for d, k in enumerate(order):
            for w, x in sorted(statistics.impacts(bag[k]).items(), key=lambda wx: (wx[1], wx[0])):
                lists[self.term[w]].append((d, x))
                if self.granted[d] + x <= SLACK:
                    self.granted[d] += x
                else:
                    strong[self.term[w]].append((d, x))
        self.postings = []
        for own in lists:
            cuts = [own[k : k + BLOCK] for k in range(0, len(own), BLOCK)]
            self.postings.append(([d for d, _ in own], [x for _, x in own], [c[-1][0] for c in cuts], [max(x for _, x in c) for c in cuts], max(x for _, x in own)))
        # The strong postings of all terms in one array, each term's from its start.
        self.start = np.cumsum([0, *map(len, strong)])
        flat = [p for own in strong for p in own]
        self.item = np.array([d for d, _ in flat], np.int64)
        self.impact = np.array([x for _, x in flat], np.float64)

    def search(self, terms: list[int], threshold: float | None = None) -> list[tuple[int, float]]:
        """Block-max WAND: (place of the item, score) of the items whose score reaches the threshold. terms: distinct."""
        threshold = self.threshold if threshold is None else threshold
        least = threshold - 1e-9
        cursors = [Cursor(self.postings[t]) for t in terms]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c.doc)
            total, p = 0.0, 0
            for p, c in enumerate(cursors):  # noqa: B007
                total += c.most
                if total >= least:
                    break
            else:
                break
            pivot = cursors[p].doc
            while p + 1 < len(cursors) and cursors[p + 1].doc == pivot:
                p += 1
            ahead = cursors[: p + 1]
            if not all([c.shallow(pivot) for c in ahead]):
                cursors = [c for c in ahead if c.block < len(c.lasts)] + cursors[p + 1 :]
                continue
            if sum(c.tops[c.block] for c in ahead) < least:  # no item up to the end of the nearest block can reach it
                beyond = min(c.lasts[c.block] for c in ahead) + 1
                if p + 1 < len(cursors):
                    beyond = min(beyond, cursors[p + 1].doc)
                cursors = [c for c in ahead if c.seek(max(beyond, pivot + 1))] + cursors[p + 1 :]
            elif cursors[0].doc == pivot:
                score = fsum(c.impacts[c.at] for c in ahead)
                if score >= least:
                    found.append((pivot, score))
                cursors = [c for c in ahead if c.seek(pivot + 1)] + cursors[p + 1 :]
            else:
                cursors = [c for c in ahead if c.doc == pivot or c.seek(pivot)] + cursors[p + 1 :]
        return found

    def could_reach(self, passage: np.ndarray, term: np.ndarray, passages: int) -> np.ndarray:
        """The passages, of so many, that could reach the threshold with some item. Rows: a passage and one of its distinct terms."""
        n = self.start[term + 1] - self.start[term]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.start[term] - ends + n, n)
        key = np.repeat(passage * len(self.ids), n) + self.item[at]
        bound = np.bincount(key, self.impact[at], minlength=passages * len(self.ids)).reshape(passages, -1) + self.granted
        return np.nonzero((bound >= self.threshold - 1e-9).any(1))[0]

    def match(self, text: str | None, question: float = QUESTION, answer: float = ANSWER) -> list[tuple[Any, float, float, float, int]]:
        """(item, score, question overlap, answer overlap, first word of the passage), the best passage of each item."""
        words = words_of(text)
        known = self.term.get
        passages = max(1, -(-len(words) // self.half) - 1)  # each has two halves
        best: dict[int, tuple[float, float, float, int]] = {}
        step = max(1, SLICE // max(len(self.term), len(self.ids), 1))
        for low in range(0, passages, step):
            n = min(step, passages - low)
            own = words[low * self.half : (low + n + 1) * self.half]
            ids = np.array([known(w, -1) for w in own], np.int64)
            at = np.nonzero(ids >= 0)[0]
            if not len(at):
                continue
            present = np.zeros((n + 1, len(self.term)), bool)
            present[at // self.half, ids[at]] = True
            passage, term = np.nonzero(present[:-1] | present[1:])
            for p in self.could_reach(passage, term, n).tolist():
                own = term[np.searchsorted(passage, p) : np.searchsorted(passage, p, "right")].tolist()
                start = (low + p) * self.half
                held: dict[int, set[bytes]] = {}
                for d, score in self.search(own):
                    for n, _ in self.parts[d]:
                        if n not in held:
                            held[n] = shingles(words[start : start + 2 * self.half], n)
                    share = [len(x & held[n]) / len(x) if x else 1.0 for n, x in self.parts[d]]
                    if share[0] >= question and share[1] >= answer:
                        mine = (score, share[0], share[1], start)
                        if d not in best or mine[:3] > best[d][:3]:
                            best[d] = mine
        return [(self.ids[d], *x) for d, x in sorted(best.items())]


def indexes(benchmark: DataFrame, text: str, ident: str, threshold: float, part: int) -> Iterator[Index]:
    """Indexes of at most ``part`` postings each (one item at least), of all the benchmark's rows."""
    rows = benchmark.filter(F.col(text).isNotNull() & F.col(ident).isNotNull()).select(F.col(ident), F.col(text)).orderBy(ident, text)
    whole = Statistics()
    for r in rows.toLocalIterator():
        whole.add(r[1])
    own: list[tuple[Any, str]] = []
    size = 0
    for r in rows.toLocalIterator():
        n = len(set(words_of(r[1])))
        if own and size + n > part:
            yield Index(own, whole, threshold)
            own, size = [], 0
        own.append((r[0], r[1]))
        size += n
    if own:
        yield Index(own, whole, threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", ident: str = "doc_id", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, part: int = PART) -> DataFrame:
    """Rows of ``ident``, ``item``, score, question_overlap, answer_overlap, passage_word: every verified pair."""
    spark = prepare(docs.sparkSession)
    kinds = [docs.schema[ident].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()]
    shape = f"`{ident}` {kinds[0]}, `{item}` {kinds[1]}, score double, question_overlap double, answer_overlap double, passage_word long"
    of_item = spark.createDataFrame([], benchmark.schema).select(item).toArrow().schema.field(0).type
    found = []
    for own in indexes(benchmark, item_text, item, threshold, part):
        index = spark.sparkContext.broadcast(own)

        def query(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(i.as_py(), *m) for i, t in zip(batch.column(0), batch.column(1), strict=True) for m in index.value.match(t.as_py(), question, answer)]
                types = [batch.column(0).type, of_item, pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], [ident, item, "score", "question_overlap", "answer_overlap", "passage_word"])

        found.append(docs.select(F.col(ident), F.col(text)).mapInArrow(query, shape))
    if not found:
        return spark.createDataFrame([], shape)
    return reduce(DataFrame.union, found).distinct()


def _clean(index, question: float, answer: float):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not index.value.match(t, question, answer) for t in texts], dtype=bool)

    return clean


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, part: int = PART) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; every row is judged by itself, so nothing is shuffled."""
    spark = prepare(docs.sparkSession)
    for own in indexes(benchmark, item_text, item, threshold, part):
        docs = docs.filter(_clean(spark.sparkContext.broadcast(own), question, answer)(F.coalesce(F.col(text), F.lit(""))))
    return docs
