"""Rendering of amounts and times of day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(cents: Column) -> Column:
    """$12.05, with a sign in front of the dollar sign when negative."""
    size = F.abs(cents)
    sign = F.when(cents < 0, "-").otherwise("")
    whole = (size - size % 100) / 100
    return F.concat(sign, F.lit("$"), whole.cast("bigint").cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def clock(ms: Column) -> Column:
    """HH:MM:SS of a span of milliseconds, signed; hours go past 24."""
    seconds = F.abs(ms) - F.abs(ms) % 1000
    part = lambda step, most: F.lpad((F.floor(seconds / step) % most).cast("string"), 2, "0")
    hours = F.floor(seconds / 3_600_000).cast("string")
    sign = F.when(ms < 0, "-").otherwise("")
    return F.concat(sign, F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), part(60_000, 60), F.lit(":"), part(1000, 60))
