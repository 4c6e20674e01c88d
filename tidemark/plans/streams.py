"""Streaming twins of the window queries: run to completion and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import aggregates
from tidemark.operators.windows import Tumbling
from tidemark.plans.queries import DIS, HOUR, LATENESS, MINUTE, WIDE, arrivals, floor, islands, query, simple
from tidemark.streaming import lateness
from tidemark.streaming.run import FLUSH, Append, Setting, Upsert, feed, run, run_failing, shared_folder, stream

BATCHES = 4
#: More batches, and no bound on disorder, give more late rows and corrections.
LATE_BATCHES = 8
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fed(spark: SparkSession, sf_dir: str, past: int, batches: int = BATCHES) -> tuple[str, str]:
    """Folders of a run, the first with the arrivals and a row that moves the watermark past all windows."""
    rows = arrivals(spark, sf_dir).cache()
    try:
        folder = shared_folder(spark)
        end = rows.agg(F.max("event_ms")).first()[0]
        feed(rows, f"{folder}/in", batches, None if end is None else end + past)
        return f"{folder}/in", folder
    finally:
        rows.unpersist()


def hours(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy("k", F.window("ts", f"{HOUR} milliseconds").alias("w")).agg(aggregates.total().alias("total"))
    return grouped.select("k", F.unix_millis("w.start").alias("window_start_ms"), F.unix_millis("w.end").alias("window_end_ms"), "total")


HOURLY = f"SELECT k, window_start_ms, window_end_ms, total FROM ({simple('d', floor('event_ms', HOUR), HOUR, 'k', 'sum(value)', 'total')})"
CELL = ["k", "window_start_ms", "window_end_ms"]


@query(f"WITH {DIS} {HOURLY}")
def stream_tumbling_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends each window once, when the watermark has passed it."""
    given, folder = fed(spark, sf_dir, 2 * WIDE)
    sink = Upsert(f"{folder}/out", CELL)
    run(hours(stream(spark, given, WIDE)), sink, f"{folder}/checkpoint", "append")
    return sink.read(spark).where(F.col("k") != FLUSH)


@query(f"WITH {DIS} {HOURLY}")
def stream_update_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early results of every batch, of which the sink keeps the last."""
    given, folder = fed(spark, sf_dir, 2 * WIDE)
    sink = Upsert(f"{folder}/out", CELL)
    run(hours(stream(spark, given, WIDE)), sink, f"{folder}/checkpoint", "update")
    return sink.read(spark).where(F.col("k") != FLUSH)


@query(f"WITH {DIS}, {islands(30 * MINUTE, 'u', 'sum(value)', 'total', 'd')}")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, folder = fed(spark, sf_dir, 3 * WIDE)
    gap = F.session_window("ts", f"{30 * MINUTE - 1} milliseconds")
    grouped = stream(spark, given, WIDE).groupBy("u", gap.alias("w")).agg(aggregates.total().alias("total"))
    ends = F.unix_millis("w.end") + 1
    found = grouped.select("u", F.unix_millis("w.start").alias("window_start_ms"), ends.alias("window_end_ms"), "total", (ends - 1).alias("event_ms"))
    sink = Upsert(f"{folder}/out", ["u", "window_start_ms", "window_end_ms"])
    run(found, sink, f"{folder}/checkpoint", "append")
    return sink.read(spark).where("u >= 0")


def late_hours(spark: SparkSession, given: str, bound: int) -> DataFrame:
    rows = stream(spark, given, 2 * WIDE).select("seq", "k", "value", "event_ms", "ts")
    return lateness.late_windows(rows, ["k"], Tumbling(HOUR), aggregates.Total(), "long", bound, LATENESS, 2 * WIDE)


@query(f"WITH {DIS} {HOURLY}")
def stream_tws_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emissions and re-emissions of the stateful operator, the last of each window; with this bound no row is late."""
    given, folder = fed(spark, sf_dir, 8 * WIDE)
    sink = Upsert(f"{folder}/out", CELL)
    with Setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKS):
        run(late_hours(spark, given, WIDE).where("NOT is_late"), sink, f"{folder}/checkpoint", "update")
    return sink.read(spark).where(F.col("k") != FLUSH).select(*CELL, F.col("result").alias("total"))


# A batch works by the watermark that the batches before it left; the last one here comes after the rows that flush.
LATE_LOG = f"""WITH {DIS}, p AS (SELECT *, seq // CAST(ceil((SELECT count(*) FROM d) / {LATE_BATCHES}.0) AS BIGINT) AS b FROM d),
    marks AS (SELECT x.b, CASE WHEN x.b = {LATE_BATCHES + 1} THEN 9000000000000000 ELSE (SELECT max(event_ms) FROM p WHERE p.b < x.b) END AS wm
        FROM (SELECT unnest(range(0, {LATE_BATCHES + 2})) AS b) x),
    m AS (SELECT p.*, wm, {floor("event_ms", HOUR)} AS ws FROM p JOIN marks USING (b)),
    fired AS (SELECT k, ws, value, (SELECT min(n.b) FROM marks n WHERE n.b >= m.b AND n.wm >= ws + {HOUR}) AS f FROM m WHERE wm IS NULL OR ws + {HOUR + LATENESS} > wm),
    sums AS (SELECT k, ws, f, sum(value) AS v FROM fired GROUP BY ALL)
    SELECT k, f AS batch, false AS is_late, ws AS window_start_ms, ws + {HOUR} AS window_end_ms,
        CAST(sum(v) OVER (PARTITION BY k, ws ORDER BY f) AS BIGINT) AS total, NULL::BIGINT AS event_ms, NULL::BIGINT AS value FROM sums
    UNION ALL SELECT k, b, true, NULL, NULL, NULL, event_ms, value FROM m WHERE ws + {HOUR + LATENESS} <= wm"""


@query(LATE_LOG)
def stream_late_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every emission, corrected ones too, and every late row, with the micro-batch that gave them."""
    given, folder = fed(spark, sf_dir, 8 * WIDE, LATE_BATCHES)
    sink = Append(f"{folder}/out", [])
    with Setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKS):
        run(late_hours(spark, given, 0), sink, f"{folder}/checkpoint", "update")
    found = sink.batches(spark).where(F.col("k") != FLUSH).withColumn("batch", F.col("batch").cast("long"))
    return found.select("k", "batch", "is_late", "window_start_ms", "window_end_ms", F.col("result").alias("total"), "event_ms", "value")


@query(f"WITH {DIS} {HOURLY}")
def stream_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sink fails after it has written a batch; the next run does that batch again and the rest."""
    given, folder = fed(spark, sf_dir, 2 * WIDE)
    found, checkpoint = hours(stream(spark, given, WIDE)), f"{folder}/checkpoint"
    run_failing(found, Upsert(f"{folder}/out", CELL, fail_at=2), checkpoint, "update")
    sink = Upsert(f"{folder}/out", CELL)
    run(found, sink, checkpoint, "update")
    return sink.read(spark).where(F.col("k") != FLUSH)


@query(f"WITH {DIS} {HOURLY}")
def stream_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As recovery, with another number of shuffle partitions: the state keeps its own, like key groups."""
    given, folder = fed(spark, sf_dir, 2 * WIDE)
    found, checkpoint, key = hours(stream(spark, given, WIDE)), f"{folder}/checkpoint", "spark.sql.shuffle.partitions"
    with Setting(spark, key, "4"):
        run_failing(found, Upsert(f"{folder}/out", CELL, fail_at=1), checkpoint, "update")
    sink = Upsert(f"{folder}/out", CELL)
    with Setting(spark, key, "9"):
        run(found, sink, checkpoint, "update")
    return sink.read(spark).where(F.col("k") != FLUSH)


