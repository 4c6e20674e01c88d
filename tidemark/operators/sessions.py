"""Session windows: an exact gap parts two sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import Session


def sessions(rows: DataFrame, keys: list[str], session: Session, **aggregates: Column) -> DataFrame:
    """Sessions of rows none of which is late: key, window, the aggregates.

    The built-in session window joins rows that are exactly a gap apart. Event time is in whole milliseconds, so a gap
    one shorter parts them, and the window's end gets the millisecond back.
    """
    at = F.session_window(F.timestamp_millis("event_ms"), f"{session.gap - 1} milliseconds") if session.gap > 1 else None
    if at is None:  # every millisecond is a session
        grouped = rows.withColumn("window_start_ms", F.col("event_ms")).groupBy(*keys, "window_start_ms").agg(*(a.alias(n) for n, a in aggregates.items()))
        found = grouped.withColumn("window_end_ms", F.col("window_start_ms") + 1)
    else:
        grouped = rows.groupBy(*keys, at.alias("w")).agg(*(a.alias(n) for n, a in aggregates.items()))
        found = grouped.withColumn("window_start_ms", F.unix_millis("w.start")).withColumn("window_end_ms", F.unix_millis("w.end") + 1).drop("w")
    return found.withColumn("event_ms", F.col("window_end_ms") - 1).select(*keys, "window_start_ms", "window_end_ms", *aggregates, "event_ms")


def islands(rows: DataFrame, keys: list[str], session: Session) -> DataFrame:
    """The rows with their session's start, by gaps and islands; for what has to see the rows of a session."""
    order = Window.partitionBy(*keys).orderBy("event_ms", "seq")
    before = F.max("event_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.withColumn("_new", F.when(before.isNull() | (F.col("event_ms") >= before + session.gap), F.col("event_ms")))
    return starts.withColumn("window_start_ms", F.last("_new", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
