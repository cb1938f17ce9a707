"""Token counts by byte-pair merging over a linked list of symbols, with a heap of adjacent pairs.

The count is the number of initial symbols less the merges; no identifiers are made. A text falls into segments that no
vocabulary piece can span (two neighbouring characters that stand together in no piece are never merged), so segments
are counted one by one and their counts kept in a bounded table.

Defined cases: a null text counts as an empty one (0 tokens); an empty table gives an empty result; repeated rows give
repeated results; a null identifier is passed on; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloop.llm.common import prepare

#: Segments whose counts a Python worker keeps, and the longest segment that is kept.
CACHE_SEGMENTS, CACHE_CHARS = 400_000, 64
SPACE, LOW = "▁", (1 << 40) - 1


class PieceCounter:
    """Counts tokens as a sentencepiece BPE model with byte fallback would."""

    def __init__(self, pieces: dict[str, int], mark: str = SPACE):
        """pieces: merge rank by piece (lower first); mark: the character that stands for a space."""
        # A heap entry is one integer: the rank above, the place of the pair's left symbol below.
        self.rank, self.mark, self.cache, self.runs = {p: r << 40 for p, r in pieces.items()}, mark, {}, {}
        self.known = {p for p in pieces if len(p) == 1}
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        # A segment starts at a run of marks unless some piece has a mark after another character.
        whole = any(p[1] == mark != p[0] for p in self.pairs)
        self.segments = re.compile(".+" if whole else f"{mark}+[^{mark}\n]*|[^{mark}\n]+|\n" if not any("\n" in p for p in self.pairs) else f"{mark}+[^{mark}]*|[^{mark}]+", re.S)

    @classmethod
    def load(cls, path: str) -> PieceCounter:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        order = sorted({sp.get_score(i) for i in normal}, reverse=True)
        place = {s: k for k, s in enumerate(order)}
        return cls({sp.id_to_piece(i): place[sp.get_score(i)] for i in normal})

    def merged(self, run: str) -> int:
        """Tokens of a run of characters: a heap of pairs over a doubly linked list."""
        get, n = self.rank.get, len(run)
        text, after, before = list(run), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [k + i for i, k in enumerate(map(get, map(add, run, run[1:]))) if k is not None]
        heapify(heap)
        # A character that is no piece counts for its bytes.
        known = self.known.issuperset(run)
        weight = None if known else [1 if c in self.known else len(c.encode("utf-8", "surrogatepass")) for c in run]
        count = n if known else sum(weight)
        while heap:
            entry = heappop(heap)
            i = entry & LOW
            j = after[i]
            if j >= n or not text[i] or get(piece := text[i] + text[j]) != entry - i:
                continue  # one of the two has been merged meanwhile
            if known:
                count -= 1
            else:
                count -= weight[i] + weight[j] - 1
                weight[i] = 1
            text[i], text[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(piece + text[k])) is not None:
                    heappush(heap, r + i)
            h = before[i]
            if h >= 0 and (r := get(text[h] + piece)) is not None:
                heappush(heap, r + h)
        return count

    def kept(self, run: str) -> int:
        """The count of a run, from the table if it is there."""
        cache = self.runs
        n = cache.get(run)
        if n is None:
            n = self.merged(run)
            if len(run) <= CACHE_CHARS:
                if len(cache) >= CACHE_SEGMENTS:
                    cache.clear()
                cache[run] = n
        return n

    def segment(self, s: str) -> int:
        """Tokens of a segment, cut further wherever two neighbouring characters stand together in no piece."""
        total, start, pairs = 0, 0, self.pairs
        for i, pair in enumerate(map(add, s, s[1:]), 1):
            if pair not in pairs:
                total += self.kept(s[start:i])
                start = i
        return total + self.kept(s[start:])

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, cache = 0, self.cache
        for s in self.segments.findall(self.mark + text.replace(" ", self.mark)):
            n = cache.get(s)
            if n is None:
                n = self.segment(s)
                if len(s) <= CACHE_CHARS:
                    if len(cache) >= CACHE_SEGMENTS:
                        cache.clear()
                    cache[s] = n
            total += n
        return total


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter.load(path)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, model_path: str, text: str = "text", ident: str = "doc_id", limit: int = 4096) -> DataFrame:
    """Rows of ``ident``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    prepare(df.sparkSession)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(model_path)
        for texts in batches:
            yield pd.Series([c.count(t) for t in texts], dtype="int64")

    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(ident), F.octet_length(whole).cast("long").alias("n_bytes"), tokens(whole).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
