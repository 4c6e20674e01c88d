"""Event time in whole milliseconds since the epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def millis(ts: str) -> Column:
    """Milliseconds of a timestamp without time zone, whatever the session's zone; floored, also before the epoch."""
    return F.expr(f"CAST(floor(timestampdiff(MICROSECOND, {EPOCH}, {ts}) / 1000) AS BIGINT)")


def timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def floor_to(ms: Column, size: int) -> Column:
    """Start of the size-aligned step that holds ms; integers only, right before the epoch too."""
    return ms - F.pmod(ms, F.lit(size))
