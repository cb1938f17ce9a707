"""Message combiners: aggregates with a partial and a final phase, chosen by name, given as a function, or written by a user."""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Combiner = Callable[[Column], Column]

#: ``any`` keeps one of equal messages; ``collect`` keeps the bag.
COMBINERS: dict[str, Combiner] = {
    "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "bit_or": F.bit_or, "bit_and": F.bit_and, "any": F.max, "bool_or": F.bool_or, "bool_and": F.bool_and, "collect": F.collect_list, "avg": F.avg,
}


class UserCombiner(ABC):
    """A combiner in three phases: messages are folded into partial results where they are made, these are merged after the
    shuffle, and the last one is finished. Merging must not depend on order."""

    #: SQL type of what ``finish`` gives.
    result_type = "double"

    @abstractmethod
    def init(self) -> Any: ...

    @abstractmethod
    def step(self, part: Any, to: int, message: Any) -> Any: ...

    @abstractmethod
    def merge(self, part: Any, other: Any) -> Any: ...

    def finish(self, part: Any) -> Any:
        return part


def combiner(how: str | Combiner) -> Combiner:
    if callable(how):
        return how
    if how not in COMBINERS:
        raise ValueError(f"no combiner {how!r}; there are {', '.join(COMBINERS)}")
    return COMBINERS[how]


def combine_messages(messages: DataFrame, how: str | Combiner | UserCombiner, to: str = "dst", msg: str = "msg") -> DataFrame:
    """(to, msg) with one row per target; partial aggregation runs before the shuffle."""
    if isinstance(how, UserCombiner):
        return _by_user(messages, how, to, msg)
    return messages.groupBy(to).agg(combiner(how)(F.col(msg)).alias(msg))


def _by_user(messages: DataFrame, how: UserCombiner, to: str, msg: str) -> DataFrame:
    """Runs of equal targets are folded from sorted streams, before and after the shuffle; one run is held at a time."""
    key = messages.schema[to].dataType.simpleString()

    def folded(begin, add, end, source: str):
        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, part = None, None
            for rows in batches:
                out = []
                for k, m in zip(rows[to], rows[source], strict=True):
                    if part is None or k != now:
                        if part is not None:
                            out.append((now, end(part[0])))
                        now, part = k, (begin(k, m),)
                    else:
                        part = (add(part[0], k, m),)
                yield pd.DataFrame({to: [k for k, _ in out], msg: pd.Series([v for _, v in out], dtype=object)})
            if part is not None:
                yield pd.DataFrame({to: [now], msg: pd.Series([end(part[0])], dtype=object)})

        return fold

    first = folded(lambda k, m: how.step(how.init(), k, m), lambda p, k, m: how.step(p, k, m), pickle.dumps, msg)
    last = folded(lambda _, m: pickle.loads(m), lambda p, _, m: how.merge(p, pickle.loads(m)), how.finish, msg)
    parts = messages.select(to, msg).sortWithinPartitions(to).mapInPandas(first, f"`{to}` {key}, `{msg}` binary")
    return parts.repartition(to).sortWithinPartitions(to).mapInPandas(last, f"`{to}` {key}, `{msg}` {how.result_type}")
