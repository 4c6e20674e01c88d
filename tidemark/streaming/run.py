"""Structured Streaming runs to completion: micro-batch sources, upsert sinks, recovery, flush."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "seq long, k string, u long, value long, event_ms long"

#: Key of the rows that only move the watermark on at the end of the input.
FLUSH = "\u0000flush"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder, which driver and executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{sc.getCheckpointDir()}/stream-{uuid.uuid4()}"


def feed(rows: DataFrame, folder: str, batches: int, flush_ms: int | None = None) -> None:
    """Writes rows (seq, k, u, value, event_ms) as files that a stream reads one a micro-batch, in order of seq.

    flush_ms: event time of a last row under FLUSH, which moves the watermark past the windows still open.
    """
    spark = rows.sparkSession
    last = rows.agg(F.max("seq")).first()[0]
    size = -(-((last or 0) + 1) // batches)
    for b in range(batches):
        part = rows.where(F.col("seq").between(b * size, (b + 1) * size - 1)).select("seq", "k", "u", "value", "event_ms")
        part.coalesce(1).write.mode("append").parquet(folder)
    if flush_ms is not None:
        # A second one, since a batch is cleaned up by the watermark that the batch before it left.
        for i in range(2):
            spark.createDataFrame([((last or 0) + 1 + i, FLUSH, -1, 0, flush_ms + i)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark: SparkSession, folder: str, delay_ms: int) -> DataFrame:
    """The rows as a stream with a watermark on ts."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return rows.withColumn("ts", F.timestamp_millis("event_ms")).withWatermark("ts", f"{delay_ms} milliseconds")


class Upsert:
    """Keeps the last row of each key, batch by batch, so that a batch that comes again changes nothing.

    Every batch is written under its number, replacing what an earlier try left; reading takes each key's row of the
    highest batch.
    """

    def __init__(self, folder: str, keys: list[str], fail_at: int | None = None) -> None:
        self.folder, self.keys, self.fail_at = folder, keys, fail_at

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        if number == self.fail_at:
            raise RuntimeError(f"told to fail after writing batch {number}")

    def read(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.option("basePath", self.folder).parquet(f"{self.folder}/batch=*")
        rest = [c for c in rows.columns if c not in (*self.keys, "batch")]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*self.keys, "r.*")


class Append(Upsert):
    """Keeps every row, as a sink without keys does."""

    def batches(self, spark: SparkSession) -> DataFrame:
        """The rows with the number of their batch."""
        return spark.read.option("basePath", self.folder).parquet(f"{self.folder}/batch=*")

    def read(self, spark: SparkSession) -> DataFrame:
        return self.batches(spark).drop("batch")


def run(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> list[dict]:
    """Runs over all there is; returns the batches' progress. A failed batch comes again at the next run."""
    query: StreamingQuery = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    try:
        query.awaitTermination()
        return [p if isinstance(p, dict) else p.asDict() if hasattr(p, "asDict") else p for p in query.recentProgress]
    finally:
        query.stop()


def run_failing(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> str:
    """Runs until the sink fails; returns what it said."""
    try:
        run(df, sink, checkpoint, mode)
    except StreamingQueryException as e:
        return str(e)
    raise AssertionError("the sink was to fail")


class Setting:
    """A setting of the session for the time of a run."""

    def __init__(self, spark: SparkSession, key: str, value: str) -> None:
        self.spark, self.key, self.value = spark, key, value

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.key, None)
        self.spark.conf.set(self.key, self.value)

    def __exit__(self, *_: object) -> None:
        if self.before is None:
            self.spark.conf.unset(self.key)
        else:
            self.spark.conf.set(self.key, self.before)
