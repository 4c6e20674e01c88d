"""Event rows with whole-millisecond event time and an explicit arrival order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import millis
from tidemark.operators.scan import numbered

#: Spread of the synthetic delays, and the factor that scatters them.
DELAY_MS, SCATTER = 7_200_000, 2_654_435_761

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """An in-memory source: rows in their order, numbered by seq."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"seq long, {schema}")


def canonical(df: DataFrame, ts: str, keys: dict[str, str], value: Column) -> DataFrame:
    """Named keys, value and event_ms of any table with a timestamp."""
    return df.select(*(F.col(c).alias(k) for k, c in keys.items()), value.alias("value"), millis(ts).alias("event_ms"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, k (type), u (user), value (cents), event_ms; in order of time, so that seq is event_id."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return canonical(table(spark, sf_dir, "events"), "ts", {"event_id": "event_id", "k": "event_type", "u": "user_id"}, cents)


def disordered(rows: DataFrame) -> DataFrame:
    """The events as they would arrive with scattered delays; seq numbers the arrivals from 0."""
    delay = F.col("event_id") * SCATTER % DELAY_MS
    return numbered(rows.withColumn("arrival", F.col("event_ms") + delay), ["arrival", "event_id"], "seq").drop("arrival")


def replay(rows: DataFrame, offset: int) -> DataFrame:
    """What a source rewound to an offset gives again."""
    return rows.where(F.col("seq") >= offset)


def until(rows: DataFrame, offset: int) -> DataFrame:
    """What a source gives before it fails at an offset."""
    return rows.where(F.col("seq") < offset)


def sane(rows: DataFrame, low_ms: int, high_ms: int) -> DataFrame:
    """Rows with an event time within bounds. Comes before any watermark: one far-off time would make the rest late."""
    return rows.where(F.col("event_ms").between(low_ms, high_ms))
