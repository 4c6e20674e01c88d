"""Window aggregation with per-record watermarks: final values, every emission, late rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import watermarks
from tidemark.operators.scan import ROWS, SPAN_MS, next_at_least
from tidemark.operators.windows import Sliding, Tumbling, assign


@dataclass(frozen=True)
class Windowed:
    """A window aggregation over rows with seq and event_ms. keys: none for windows over all rows."""

    rows: DataFrame
    keys: tuple[str, ...]
    windows: Tumbling | Sliding
    bound_ms: int
    lateness_ms: int = 0

    def _marked(self) -> DataFrame:
        return watermarks.exact(self.rows, self.bound_ms)

    def _live(self) -> Column:
        """Whether the window can still take the row when it arrives."""
        return F.col("wm_before").isNull() | (F.col("window_end_ms") + self.lateness_ms > F.col("wm_before"))

    def admitted(self) -> DataFrame:
        """A row for each window that takes the row."""
        return assign(self._marked(), self.windows).where(self._live())

    def late(self) -> DataFrame:
        """Rows that no window takes, the side output. One that some of its windows take isn't late."""
        live = F.exists(self.windows.starts(F.col("event_ms")), lambda s: F.col("wm_before").isNull() | (s + self.windows.size + self.lateness_ms > F.col("wm_before")))
        return self._marked().where(~live).drop("wm_before", "wm_after", "advance")

    def final(self, **aggregates: Column) -> DataFrame:
        """Each key and window's last value."""
        grouped = self.admitted().groupBy(*self.keys, "window_start_ms", "window_end_ms")
        return grouped.agg(*(a.alias(n) for n, a in aggregates.items())).withColumn("event_ms", F.col("window_end_ms") - 1)

    def fired(self) -> DataFrame:
        """Admitted rows with fire_seq: the record whose watermark first emits them; null at the end of the input.

        That is the first one that moves the watermark on, not before the row itself, nor before the watermark has
        reached the window's end.
        """
        marked = self._marked()
        moves = marked.where("advance").select("seq", "wm_after")
        rows = assign(marked, self.windows).where(self._live())
        ends = rows.select("window_end_ms").distinct()
        reached = next_at_least(ends, "window_end_ms", moves, "wm_after", "seq", "reached", SPAN_MS)
        rows = rows.join(reached, "window_end_ms").withColumn("due", F.greatest("seq", "reached"))
        open_ = rows.where("reached IS NULL").withColumn("fire_seq", F.lit(None).cast("bigint"))
        due = next_at_least(rows.where("reached IS NOT NULL"), "due", moves.withColumnRenamed("seq", "move"), "move", "move", "fire_seq", ROWS)
        return due.unionByName(open_).drop("reached", "due", "wm_before", "wm_after", "advance")

    def emissions(self, value: str = "value") -> DataFrame:
        """Every emission of a running sum: key, window, fire_seq (null: at the end), value so far, and its number."""
        cell = [*self.keys, "window_start_ms", "window_end_ms"]
        fires = self.fired().groupBy(*cell, "fire_seq").agg(F.sum(value).alias("_v"))
        order = F.col("fire_seq").asc_nulls_last()
        so_far = Window.partitionBy(*cell).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        fires = fires.withColumn("value", F.sum("_v").over(so_far).cast("bigint")).withColumn("emission", F.count("*").over(so_far))
        return fires.drop("_v").withColumn("event_ms", F.col("window_end_ms") - 1)

    def open_windows(self) -> DataFrame:
        """Windows that still hold state when the input stops: those that the last watermark hasn't purged."""
        last = self._marked().agg(F.max("wm_after").alias("last"))  # one row
        cells = self.admitted().select(*self.keys, "window_start_ms", "window_end_ms").distinct()
        return cells.join(F.broadcast(last), F.col("window_end_ms") + self.lateness_ms > F.col("last")).drop("last")
