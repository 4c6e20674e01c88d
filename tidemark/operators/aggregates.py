"""Aggregators: built-in ones as columns, and the contract of user-defined ones."""

from __future__ import annotations

import pickle
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(col: str = "value") -> Column:
    return F.sum(col).cast("bigint")


def count() -> Column:
    return F.count(F.lit(1))


def collect(col: str = "value", order: str = "seq") -> Column:
    """Values in order of arrival, whichever order the shuffle gives them in."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, col))), lambda x: x[col])


class Aggregator:
    """A user-defined aggregate: create an accumulator, add a value, merge two accumulators, give the result.

    Accumulators go from task to task, so they have to be pickled. merge has to be associative; values come in order
    of arrival within a part, and parts in order of arrival, so it needn't be commutative.
    """

    def create(self) -> Any:
        raise NotImplementedError

    def add(self, acc: Any, value: Any) -> Any:
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def result(self, acc: Any) -> Any:
        raise NotImplementedError

    def fold(self, acc: Any, values: list) -> Any:
        """Adds the values one by one; for an aggregate that has a quicker way, that."""
        return reduce(self.add, values, acc)


class Total(Aggregator):
    """The sum of whole numbers."""

    def create(self) -> int:
        return 0

    def add(self, acc: int, value: int) -> int:
        return acc + value

    def merge(self, a: int, b: int) -> int:
        return a + b

    def result(self, acc: int) -> int:
        return acc

    def fold(self, acc: int, values: list[int]) -> int:
        return acc + sum(values)


#: Rows of a key's part, by order of arrival.
PART = 100_000


def aggregated(rows: DataFrame, keys: list[str], aggregator: Aggregator, kind: str, col: str = "value", order: str = "seq", name: str = "result", part: int = PART) -> DataFrame:
    """keys, name (of the SQL type kind): the aggregate of col over each key's rows.

    Accumulators are made by part (a span of the order), so that no task has all of a hot key's rows, and merged by key.
    """

    def partial(_: tuple, group: pd.DataFrame) -> pd.DataFrame:
        acc = aggregator.fold(aggregator.create(), group.sort_values(order)[col].tolist())
        return group[[*keys, "_part"]].iloc[:1].assign(_acc=[pickle.dumps(acc)])

    def final(_: tuple, group: pd.DataFrame) -> pd.DataFrame:
        accs = map(pickle.loads, group.sort_values("_part")["_acc"])
        return group[keys].iloc[:1].assign(**{name: [aggregator.result(reduce(aggregator.merge, accs))]})

    dealt = rows.select(*keys, order, col, F.floor(F.col(order) / part).alias("_part"))
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*keys).schema)
    parts = dealt.groupBy(*keys, "_part").applyInPandas(partial, f"{named}, _part bigint, _acc binary")
    return parts.groupBy(*keys).applyInPandas(final, f"{named}, {name} {kind}")
