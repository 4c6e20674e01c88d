"""Keyed running values: one output for each input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a key beyond which its running totals are made in several tasks.
HOT = 1_000_000


def running(rows: DataFrame, keys: list[str], aggregate: Column, name: str = "running") -> DataFrame:
    """Adds the aggregate of the key's rows up to this one, by order of arrival. A key's rows are one task's; what can
    be added up goes through running_total."""
    return rows.withColumn(name, aggregate.over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def running_total(rows: DataFrame, keys: list[str], value: Column, name: str = "running", hot: int = HOT) -> DataFrame:
    """Adds the sum of value over the key's rows up to this one, by order of arrival. F.lit(1) counts.

    A key of more than hot rows is cut by arrival into parts, whose totals carry over; most keys have one part.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("seq").alias("_last")).where(F.col("_n") > hot)
    sizes = sizes.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.greatest(F.lit(1.0), F.col("_last") / F.col("_n") * hot).alias("_width"))
    # A row for hot rows at least: their number bounds what is broadcast.
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    parts = rows.withColumn("_v", value).join(F.broadcast(sizes), same, "left").withColumn("_part", F.coalesce(F.floor(F.col("seq") / F.col("_width")), F.lit(0)))
    inside = Window.partitionBy(*keys, "_part").orderBy("seq")
    found = parts.withColumn("_inside", F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    tops = parts.where("_width IS NOT NULL").groupBy(*keys, "_part").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*(F.col(k).alias(f"_c_{k}") for k in keys), F.col("_part").alias("_c_part"), F.sum("_t").over(before).alias("_before"))  # a row for hot rows
    met = [F.col("_part") == F.col("_c_part"), *(F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys)]
    found = found.join(F.broadcast(tops), met, "left")
    return found.select(*(found[c] for c in rows.columns), (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(name))


def last_value(rows: DataFrame, keys: list[str], value: str, default: Column | None = None) -> DataFrame:
    """Value state: what the key held before each row; null (or the default) where nothing has been written."""
    held = F.lag(value).over(Window.partitionBy(*keys).orderBy("seq"))
    return rows.withColumn("held", held if default is None else F.coalesce(held, default))


def history(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """List state at the end of the input: the key's values in order of arrival."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", value))), lambda x: x[value]).alias("list"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: the last row written for each key, and how often it was written."""
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"), F.count("*").alias("writes"))
    return kept.select(*keys, "_row.*", "writes")
