"""Watermarks per record: how far event time has come by the time a record arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import max_before


def exact(rows: DataFrame, bound_ms: int) -> DataFrame:
    """Adds wm_before (null for the first row), wm_after and advance: event time so far, less the bound."""
    rows = max_before(rows, "seq", {"_max": F.col("event_ms")})
    rows = rows.withColumn("wm_before", F.col("_max") - bound_ms).withColumn("wm_after", F.greatest("_max", "event_ms") - bound_ms).drop("_max")
    return rows.withColumn("advance", F.col("wm_before").isNull() | (F.col("wm_after") > F.col("wm_before")))


def min_across(rows: DataFrame, channel: str, channels: int, wm: str = "wm_ms") -> DataFrame:
    """seq and merged of the updates that move the least watermark of all channels on.

    Each channel's own watermark never goes back. Until every channel has been heard there's no merged one.
    """
    own = {c: F.when(F.col(channel) == c, F.col(wm)) for c in range(channels)}
    rows = max_before(rows, "seq", {f"_b{c}": v for c, v in own.items()}).withColumns({f"_c{c}": F.greatest(f"_b{c}", v) for c, v in own.items()})
    now, before = ([F.col(f"_{x}{c}") for c in range(channels)] for x in "cb")
    merged = lambda cs: F.when(~F.exists(F.array(*cs), lambda x: x.isNull()), F.array_min(F.array(*cs)))
    rows = rows.withColumn("merged", merged(now)).withColumn("_last", merged(before))
    return rows.where("merged IS NOT NULL AND (_last IS NULL OR merged > _last)").select("seq", "merged")


def by_partition(rows: DataFrame, channel: str, bound_ms: int) -> DataFrame:
    """Each channel's own watermark after each of its rows."""
    rows = max_before(rows, "seq", {"_max": F.col("event_ms")}, keys=(channel,))
    return rows.withColumn("wm_ms", F.greatest("_max", "event_ms") - bound_ms).drop("_max")
