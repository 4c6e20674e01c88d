"""Window assigners: the windows that an event time falls into, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import floor_to


@dataclass(frozen=True)
class Tumbling:
    size: int

    def __post_init__(self) -> None:
        if self.size <= 0:
            raise ValueError("a window needs a positive size")

    def starts(self, ms: Column) -> Column:
        return F.array(floor_to(ms, self.size))


@dataclass(frozen=True)
class Sliding:
    """Every slide a window of size; with a slide above the size some times are in no window."""

    size: int
    slide: int

    def __post_init__(self) -> None:
        if self.size <= 0 or self.slide <= 0:
            raise ValueError("a window needs a positive size and slide")

    def starts(self, ms: Column) -> Column:
        newest = floor_to(ms, self.slide)
        steps = F.sequence(F.lit(0), F.lit((self.size - 1) // self.slide))
        return F.filter(F.transform(steps, lambda i: newest - i * self.slide), lambda s: s + self.size > ms)


@dataclass(frozen=True)
class Session:
    """Rows less than gap apart, by time, are one window; it ends gap after the last."""

    gap: int

    def __post_init__(self) -> None:
        if self.gap <= 0:
            raise ValueError("a session needs a positive gap")


def assign(rows: DataFrame, windows: Tumbling | Sliding) -> DataFrame:
    """A row for each window of each row, with window_start_ms and window_end_ms."""
    rows = rows.withColumn("window_start_ms", F.explode(windows.starts(F.col("event_ms"))))
    return rows.withColumn("window_end_ms", F.col("window_start_ms") + windows.size)
