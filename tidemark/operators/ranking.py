"""Ordering of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import numbered


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows; the order has to settle ties."""
    return rows.orderBy(*order).limit(k)


def nearest_rank(rows: DataFrame, value: str, percents: list[float]) -> DataFrame:
    """percent, value at index floor(percent / 100 * (n - 1)) of the sorted values; no rows give no rows."""
    ranked = numbered(rows.where(F.col(value).isNotNull()).select(F.col(value).alias("value")), ["value"], "i")
    n = rows.agg(F.count(value).alias("n"))  # one row
    wanted = n.where("n > 0").select(F.explode(F.array(*(F.lit(float(p)) for p in percents))).alias("percent"), "n")
    wanted = wanted.select("percent", F.floor(F.col("percent") / 100 * (F.col("n") - 1)).cast("bigint").alias("i"))
    return ranked.join(F.broadcast(wanted), "i").select("percent", "value")
