"""The event-time queries, each with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import formats, keygroups
from tidemark.operators import aggregates, keyed, ranking, sessions, watermarks
from tidemark.operators.windowed import Windowed
from tidemark.operators.windows import Session, Sliding, Tumbling, assign
from tidemark.sources import events as source

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

HOUR, MINUTE = 3_600_000, 60_000
#: Bound on disorder and allowed lateness of the queries with late rows; with WIDE none is late.
BOUND, LATENESS, WIDE = 30 * MINUTE, 15 * MINUTE, 3 * HOUR
SIXTY_YEARS = 60 * 365 * 86_400_000
CHANNELS = 4

EV = "ev AS (SELECT event_id, event_type AS k, user_id AS u, CAST(round(value * 100) AS BIGINT) AS value, epoch_us(ts) // 1000 AS event_ms FROM events)"
DIS = f"{EV}, d AS (SELECT *, row_number() OVER (ORDER BY event_ms + (event_id * {source.SCATTER}) % {source.DELAY_MS}, event_id) - 1 AS seq FROM ev)"


def marked(bound: int) -> str:
    return f"""{DIS}, m AS (SELECT *,
        max(event_ms) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {bound} AS wm_before,
        max(event_ms) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - {bound} AS wm_after FROM d)"""


def floor(x: str, n: int) -> str:
    return f"({x} - (({x} % {n}) + {n}) % {n})"


def sliding(rows: str, size: int, slide: int) -> str:
    """Rows with the start of each of their sliding windows."""
    return f"""(SELECT *, unnest(list_filter(list_transform(range(0, {-(-size // slide)}), lambda i: {floor('event_ms', slide)} - i * {slide}),
        lambda s: s + {size} > event_ms)) AS ws FROM {rows})"""


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.events(spark, sf_dir)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.disordered(source.events(spark, sf_dir))


# Sources, projections, filters.


@query(f"WITH {DIS} SELECT seq, event_id, k, u, value, event_ms FROM d")
def source_vector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals(spark, sf_dir).select("seq", "event_id", "k", "u", "value", "event_ms")


@query(f"WITH {DIS} SELECT seq, k, value FROM d WHERE seq >= 5000")
def source_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.replay(arrivals(spark, sf_dir), 5000).select("seq", "k", "value")


@query(f"WITH {DIS} SELECT seq, k, value FROM d WHERE seq < 5000")
def source_fail_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.until(arrivals(spark, sf_dir), 5000).select("seq", "k", "value")


@query(f"WITH {EV} SELECT event_id, value * 2 AS doubled, event_ms FROM ev")
def map_scale_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).select("event_id", (F.col("value") * 2).alias("doubled"), "event_ms")


@query(f"WITH {EV} SELECT event_id, k || ':' || CAST(value AS VARCHAR) AS label, event_ms FROM ev")
def map_type_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).select("event_id", F.concat_ws(":", "k", F.col("value").cast("string")).alias("label"), "event_ms")


@query(f"WITH {EV} SELECT event_id, value, event_ms FROM ev WHERE value > 5000")
def filter_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).where("value > 5000").select("event_id", "value", "event_ms")


@query(f"WITH {EV} SELECT event_id, value, event_ms FROM ev WHERE value > 1000000000000")
def filter_reject_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).where("value > 1000000000000").select("event_id", "value", "event_ms")


@query(f"WITH {EV} SELECT event_id, value * 10 AS value, event_ms FROM ev WHERE value * 10 > 20000")
def map_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = lambda df: df.select("event_id", (F.col("value") * 10).alias("value"), "event_ms")
    return ev(spark, sf_dir).transform(scaled).transform(lambda df: df.where("value > 20000"))


@query(f"WITH {EV} SELECT event_id, unnest(range(0, value % 4)) AS i, event_ms FROM ev WHERE value % 4 > 0")
def flat_map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint")), lambda i: i < F.col("value") % 4)
    return ev(spark, sf_dir).select("event_id", F.explode(parts).alias("i"), "event_ms")


@query(f"""WITH {EV}, p AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN -3000000000 WHEN event_id % 89 = 0 THEN 4000000000000 ELSE event_ms END AS event_ms FROM ev)
SELECT event_id, event_ms FROM p WHERE event_ms BETWEEN 1600000000000 AND 1900000000000""")
def sanitize_poison_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("event_id") % 97 == 0, -3_000_000_000).when(F.col("event_id") % 89 == 0, 4_000_000_000_000).otherwise(F.col("event_ms"))
    return source.sane(ev(spark, sf_dir).select("event_id", bad.alias("event_ms")), 1_600_000_000_000, 1_900_000_000_000)


# Watermarks.


@query(f"WITH {marked(BOUND)} SELECT seq, wm_before, wm_after, wm_before IS NULL OR wm_after > wm_before AS advance FROM m")
def watermark_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermarks.exact(arrivals(spark, sf_dir), BOUND).select("seq", "wm_before", "wm_after", "advance")


MERGED = ", ".join(f"max(CASE WHEN u % {CHANNELS} = {c} THEN wm_ms END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c{c}" for c in range(CHANNELS))
LEAST = f"CASE WHEN {' AND '.join(f'c{c} IS NOT NULL' for c in range(CHANNELS))} THEN least({', '.join(f'c{c}' for c in range(CHANNELS))}) END"


@query(f"""WITH {DIS}, w AS (SELECT seq, u, max(event_ms) OVER (PARTITION BY u % {CHANNELS} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - {BOUND} AS wm_ms FROM d),
c AS (SELECT seq, {MERGED} FROM w), l AS (SELECT seq, {LEAST} AS merged FROM c), b AS (SELECT seq, merged, lag(merged) OVER (ORDER BY seq) AS last FROM l)
SELECT seq, merged FROM b WHERE merged IS NOT NULL AND (last IS NULL OR merged > last)""")
def watermark_min_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals(spark, sf_dir).withColumn("channel", (F.col("u") % CHANNELS).cast("int"))
    return watermarks.min_across(watermarks.by_partition(rows, "channel", BOUND), "channel", CHANNELS)


# Assigners.


@query(f"WITH {EV} SELECT event_id, {floor('event_ms', HOUR)} AS window_start_ms, {floor('event_ms', HOUR)} + {HOUR} AS window_end_ms FROM ev")
def tumbling_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(ev(spark, sf_dir), Tumbling(HOUR)).select("event_id", "window_start_ms", "window_end_ms")


@query(f"WITH {EV} SELECT event_id, ws AS window_start_ms, ws + {HOUR} AS window_end_ms FROM {sliding('ev', HOUR, 15 * MINUTE)}")
def sliding_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(ev(spark, sf_dir), Sliding(HOUR, 15 * MINUTE)).select("event_id", "window_start_ms", "window_end_ms")


@query(f"WITH {EV} SELECT event_id, ws AS window_start_ms, ws + {HOUR} AS window_end_ms FROM {sliding('ev', HOUR, 2 * HOUR)}")
def sliding_gap_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(ev(spark, sf_dir), Sliding(HOUR, 2 * HOUR)).select("event_id", "window_start_ms", "window_end_ms")


@query(f"WITH {EV}, p AS (SELECT event_id, event_ms - {SIXTY_YEARS} AS event_ms FROM ev) SELECT event_id, event_ms, {floor('event_ms', HOUR)} AS window_start_ms FROM p")
def pre_epoch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = ev(spark, sf_dir).withColumn("event_ms", F.col("event_ms") - SIXTY_YEARS)
    return assign(early, Tumbling(HOUR)).select("event_id", "event_ms", "window_start_ms")


# Window aggregation without late rows.


def simple(rows: str, ws: str, size: int, keys: str, value: str, name: str) -> str:
    key = f"{keys}, " if keys else ""
    return f"""SELECT {key}{ws} AS window_start_ms, {ws} + {size} AS window_end_ms, CAST({value} AS BIGINT) AS {name}, {ws} + {size - 1} AS event_ms
        FROM {rows} GROUP BY {key}{ws}"""


@query(f"WITH {EV} {simple('ev', floor('event_ms', HOUR), HOUR, 'k', 'sum(value)', 'total')}")
def tumbling_sum_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is late where rows come in order, so that the windows are plain groups."""
    grouped = assign(ev(spark, sf_dir), Tumbling(HOUR)).groupBy("k", "window_start_ms", "window_end_ms")
    return grouped.agg(aggregates.total().alias("total")).withColumn("event_ms", F.col("window_end_ms") - 1)


@query(f"WITH {EV} {simple('ev', floor('event_ms', HOUR), HOUR, '', 'count(*)', 'n')}")
def tumbling_count_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = assign(ev(spark, sf_dir), Tumbling(HOUR)).groupBy("window_start_ms", "window_end_ms")
    return grouped.agg(aggregates.count().alias("n")).withColumn("event_ms", F.col("window_end_ms") - 1)


@query(f"""WITH {DIS} SELECT k, {floor('event_ms', HOUR)} AS window_start_ms, string_agg(CAST(value AS VARCHAR), ',' ORDER BY seq) AS collected FROM d GROUP BY k, {floor('event_ms', HOUR)}""")
def tumbling_collect_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Windowed(arrivals(spark, sf_dir), ("k",), Tumbling(HOUR), WIDE).final(collected=aggregates.collect())
    return found.select("k", "window_start_ms", F.array_join(F.transform("collected", lambda v: v.cast("string")), ",").alias("collected"))


@query(f"WITH {EV} {simple(sliding('ev', HOUR, 15 * MINUTE), 'ws', HOUR, 'k', 'sum(value)', 'total')}")
def sliding_sum_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = assign(ev(spark, sf_dir), Sliding(HOUR, 15 * MINUTE)).groupBy("k", "window_start_ms", "window_end_ms")
    return grouped.agg(aggregates.total().alias("total")).withColumn("event_ms", F.col("window_end_ms") - 1)


@query(f"WITH {EV} {simple(sliding('ev', HOUR, 15 * MINUTE), 'ws', HOUR, '', 'count(*)', 'n')}")
def sliding_count_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = assign(ev(spark, sf_dir), Sliding(HOUR, 15 * MINUTE)).groupBy("window_start_ms", "window_end_ms")
    return grouped.agg(aggregates.count().alias("n")).withColumn("event_ms", F.col("window_end_ms") - 1)


def islands(gap: int, keys: str, value: str, name: str, rows: str = "ev") -> str:
    return f"""i AS (SELECT *, CASE WHEN event_ms >= max(event_ms) OVER w + {gap} OR max(event_ms) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM {rows}
        WINDOW w AS (PARTITION BY {keys} ORDER BY event_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY event_ms, event_id) AS island FROM i)
    SELECT {keys}, min(event_ms) AS window_start_ms, max(event_ms) + {gap} AS window_end_ms, CAST({value} AS BIGINT) AS {name}, max(event_ms) + {gap - 1} AS event_ms
    FROM n GROUP BY {keys}, island"""


@query(f"WITH {EV}, {islands(30 * MINUTE, 'u', 'sum(value)', 'total')}")
def session_sum_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(ev(spark, sf_dir), ["u"], Session(30 * MINUTE), total=aggregates.total())


@query(f"WITH {EV}, {islands(2 * HOUR, 'u', 'count(*)', 'n')}")
def session_count_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(ev(spark, sf_dir), ["u"], Session(2 * HOUR), n=aggregates.count())


EXACT = f"x AS (SELECT event_id, k, value, {floor('event_ms', HOUR)} AS event_ms FROM ev)"


@query(f"WITH {EV}, {EXACT}, {islands(HOUR, 'k', 'count(*)', 'n', 'x')}")
def session_exact_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times on the hour with an hour's gap: every hour is a session of its own."""
    rows = ev(spark, sf_dir).withColumn("event_ms", F.col("event_ms") - F.col("event_ms") % HOUR)
    return sessions.sessions(rows, ["k"], Session(HOUR), n=aggregates.count())


# Late rows, allowed lateness, emissions.

TUMBLED = f"(SELECT *, {floor('event_ms', HOUR)} AS ws, {floor('event_ms', HOUR)} + {HOUR} AS we FROM m)"


def hourly(spark: SparkSession, sf_dir: str, lateness: int, windows: Tumbling | Sliding | None = None) -> Windowed:
    return Windowed(arrivals(spark, sf_dir), ("k",), windows or Tumbling(HOUR), BOUND, lateness)


@query(f"WITH {marked(BOUND)} SELECT seq, event_id, k, value, event_ms FROM {TUMBLED} WHERE wm_before IS NOT NULL AND we <= wm_before")
def late_side_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir, 0).late().select("seq", "event_id", "k", "value", "event_ms")


@query(f"WITH {marked(BOUND)} SELECT count(*) AS n_late FROM {TUMBLED} WHERE wm_before IS NOT NULL AND we + {LATENESS} <= wm_before")
def late_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir, LATENESS).late().agg(F.count("*").alias("n_late"))


SLID = sliding("m", HOUR, 15 * MINUTE)
LIVE = f"wm_before IS NULL OR ws + {HOUR} > wm_before"


@query(f"WITH {marked(BOUND)}, s AS (SELECT seq, count(*) AS n_windows, count(*) FILTER (WHERE {LIVE}) AS n_live FROM {SLID} GROUP BY seq) SELECT seq, n_windows, n_live FROM s WHERE n_live < n_windows")
def sliding_partial_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that some of their windows, or all, no longer take."""
    w = hourly(spark, sf_dir, 0, Sliding(HOUR, 15 * MINUTE))
    live = w.admitted().groupBy("seq").agg(F.count("*").alias("n_live"))
    per_row = assign(w.rows, w.windows).groupBy("seq").agg(F.count("*").alias("n_windows"))
    return per_row.join(live, "seq", "left").select("seq", "n_windows", F.coalesce("n_live", F.lit(0)).alias("n_live")).where("n_live < n_windows")


ADMITTED = f"adm AS (SELECT * FROM {TUMBLED} WHERE wm_before IS NULL OR we + {LATENESS} > wm_before)"


@query(f"WITH {marked(BOUND)}, {ADMITTED} SELECT k, ws AS window_start_ms, we AS window_end_ms, CAST(sum(value) AS BIGINT) AS total, count(*) AS n, we - 1 AS event_ms FROM adm GROUP BY k, ws, we")
def lateness_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir, LATENESS).final(total=aggregates.total(), n=aggregates.count())


LOG = f"""{marked(BOUND)}, {ADMITTED},
adv AS (SELECT seq, wm_after FROM m WHERE wm_before IS NULL OR wm_after > wm_before),
g AS (SELECT we, (SELECT min(seq) FROM adv WHERE adv.wm_after >= e.we) AS g FROM (SELECT DISTINCT we FROM adm) e),
f AS (SELECT k, ws, adm.we, value, CASE WHEN g.g IS NOT NULL THEN (SELECT min(adv.seq) FROM adv WHERE adv.seq >= greatest(adm.seq, g.g)) END AS fire_seq FROM adm JOIN g ON adm.we = g.we),
e AS (SELECT k, ws, we, fire_seq, sum(value) AS v FROM f GROUP BY k, ws, we, fire_seq),
log AS (SELECT k, ws AS window_start_ms, we AS window_end_ms, fire_seq, CAST(sum(v) OVER c AS BIGINT) AS value, count(*) OVER c AS emission, we - 1 AS event_ms
    FROM e WINDOW c AS (PARTITION BY k, ws, we ORDER BY fire_seq NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {LOG} SELECT * FROM log")
def lateness_emission_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir, LATENESS).emissions().select("k", "window_start_ms", "window_end_ms", "fire_seq", "value", "emission", "event_ms")


@query(f"WITH {LOG} SELECT k, window_start_ms, max(emission) AS emissions, arg_max(value, emission) AS last FROM log GROUP BY k, window_start_ms HAVING max(emission) > 1")
def emission_refires(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = hourly(spark, sf_dir, LATENESS).emissions()
    return log.groupBy("k", "window_start_ms").agg(F.max("emission").alias("emissions"), F.max_by("value", "emission").alias("last")).where("emissions > 1")


@query(f"""WITH {marked(BOUND)} SELECT count(*) FILTER (WHERE wm_before IS NULL OR we > wm_before) AS windowed, count(*) FILTER (WHERE wm_before IS NOT NULL AND we <= wm_before) AS late, count(*) AS total FROM {TUMBLED}""")
def conservation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = hourly(spark, sf_dir, 0)
    parts = w.admitted().select(F.lit("w").alias("p")).unionAll(w.late().select(F.lit("l").alias("p"))).unionAll(w.rows.select(F.lit("t").alias("p")))
    return parts.agg(*(F.count(F.when(F.col("p") == p, 1)).alias(n) for p, n in (("w", "windowed"), ("l", "late"), ("t", "total"))))


CUT = f"{marked(BOUND)}, pre AS (SELECT * FROM m WHERE seq < 5000), cells AS (SELECT DISTINCT k, ws, we FROM (SELECT *, {floor('event_ms', HOUR)} AS ws, {floor('event_ms', HOUR)} + {HOUR} AS we FROM pre) WHERE wm_before IS NULL OR we + {LATENESS} > wm_before)"
OPEN = f"SELECT k, ws AS window_start_ms, we AS window_end_ms FROM cells WHERE we + {LATENESS} > (SELECT max(wm_after) FROM pre)"


def cut_off(spark: SparkSession, sf_dir: str) -> Windowed:
    return Windowed(source.until(arrivals(spark, sf_dir), 5000), ("k",), Tumbling(HOUR), BOUND, LATENESS)


@query(f"WITH {CUT} {OPEN}")
def open_windows_at_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_off(spark, sf_dir).open_windows()


@query(f"WITH {CUT} SELECT count(DISTINCT k) AS n_keys FROM ({OPEN})")
def keys_with_state_at_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_off(spark, sf_dir).open_windows().agg(F.count_distinct("k").alias("n_keys"))


@query(f"""WITH {EV}, h AS ({simple('ev', floor('event_ms', HOUR), HOUR, 'k', 'sum(value)', 'total')})
SELECT {floor('event_ms', 24 * HOUR)} AS window_start_ms, CAST(sum(total) AS BIGINT) AS total, count(*) AS n FROM h GROUP BY {floor('event_ms', 24 * HOUR)}""")
def chained_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of hours: a result's event time is its window's last millisecond."""
    hours = tumbling_sum_keyed(spark, sf_dir).select("total", "event_ms")
    return assign(hours, Tumbling(24 * HOUR)).groupBy("window_start_ms").agg(aggregates.total("total").alias("total"), aggregates.count().alias("n"))


# Keyed state.


@query(f"WITH {DIS} SELECT seq, u, CAST(sum(value) OVER (PARTITION BY u ORDER BY seq) AS BIGINT) AS running, event_ms FROM d")
def keyed_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.running_total(arrivals(spark, sf_dir), ["u"], F.col("value")).select("seq", "u", "running", "event_ms")


@query(f"WITH {DIS} SELECT seq, u, count(*) OVER (PARTITION BY u ORDER BY seq) AS running, event_ms FROM d")
def keyed_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.running_total(arrivals(spark, sf_dir), ["u"], F.lit(1)).select("seq", "u", "running", "event_ms")


@query(f"WITH {DIS} SELECT seq, u, lag(value) OVER (PARTITION BY u ORDER BY seq) AS held FROM d")
def value_state_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.last_value(arrivals(spark, sf_dir), ["u"], "value").select("seq", "u", "held")


@query(f"WITH {DIS} SELECT u, string_agg(k, ',' ORDER BY seq) AS visits FROM d GROUP BY u")
def list_state_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.history(arrivals(spark, sf_dir), ["u"], "k").select("u", F.array_join("list", ",").alias("visits"))


@query(f"WITH {DIS} SELECT u, CAST(sum(value) AS BIGINT) AS total, count(*) AS n FROM d GROUP BY u")
def aggregating_state_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals(spark, sf_dir).groupBy("u").agg(aggregates.total().alias("total"), aggregates.count().alias("n"))


class Summary(aggregates.Aggregator):
    """Least, greatest, sum and number."""

    def create(self) -> tuple | None:
        return None

    def add(self, acc: tuple | None, value: int) -> tuple:
        return self.merge(acc, (value, value, value, 1))

    def merge(self, a: tuple | None, b: tuple | None) -> tuple | None:
        return a or b if a is None or b is None else (min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], a[3] + b[3])

    def result(self, acc: tuple) -> dict:
        return {"least": acc[0], "greatest": acc[1], "mean": acc[2] // acc[3]}


@query(f"WITH {EV} SELECT k, min(value) AS least, max(value) AS greatest, CAST(sum(value) AS BIGINT) // count(*) AS mean FROM ev WHERE value >= 0 GROUP BY k")
def user_defined_aggregator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, greatest and whole mean in one accumulator of the user's own."""
    rows = ev(spark, sf_dir).where("value >= 0").select("k", "value", F.col("event_id").alias("seq"))
    found = aggregates.aggregated(rows, ["k"], Summary(), "struct<least: bigint, greatest: bigint, mean: bigint>", part=20_000)
    return found.select("k", "result.*")


# Key groups.


FNV = """CAST(list_reduce(list_concat([CAST(14695981039346656037 AS HUGEINT), length(k), 0, 0, 0], list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS HUGEINT))),
    lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) % 128 AS INTEGER)"""


@query(f"WITH {EV} SELECT k, {FNV} AS key_group FROM (SELECT DISTINCT k FROM ev)")
def key_group_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).select("k").distinct().select("k", keygroups.group_of(F.col("k")).alias("key_group"))


@query("SELECT CAST(g AS INTEGER) AS key_group, CAST(p AS INTEGER) AS parallelism, CAST(g * p // 128 AS INTEGER) AS subtask FROM range(0, 128) a(g), range(1, 17) b(p)")
def key_group_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.range(keygroups.GROUPS).select(F.col("id").cast("int").alias("key_group"))
    tasks = F.array(*(F.struct(F.lit(p).alias("parallelism"), keygroups.subtask(F.col("key_group"), p).alias("subtask")) for p in range(1, 17)))
    return groups.select("key_group", F.explode(tasks).alias("t")).select("key_group", "t.parallelism", "t.subtask")


@query("SELECT CAST(p AS INTEGER) AS parallelism, CAST(s AS INTEGER) AS subtask, CAST((s * 128 + p - 1) // p AS INTEGER) AS first_group, CAST(((s + 1) * 128 + p - 1) // p AS INTEGER) AS end_group FROM range(1, 17) a(p), range(0, 16) b(s) WHERE s < p")
def key_group_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p, s, *keygroups.range_for(s, p)) for p in range(1, 17) for s in range(p)]
    return spark.createDataFrame(rows, "parallelism int, subtask int, first_group int, end_group int")


@query(f"WITH {EV}, g AS (SELECT {FNV} AS g FROM ev) SELECT CAST(g * 4 // 128 AS INTEGER) AS subtask, CAST(count(*) AS BIGINT) AS n_rows FROM g GROUP BY g * 4 // 128")
def subtask_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each of four subtasks gets."""
    counts = ev(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n"))
    task = keygroups.subtask(keygroups.group_of(F.col("k")), 4)
    return counts.select(task.alias("subtask"), "n").groupBy("subtask").agg(F.sum("n").alias("n_rows"))


# Sinks and recovery.


@query(f"WITH {DIS} SELECT u, arg_max(k, seq) AS k, arg_max(value, seq) AS value, max(seq) AS seq FROM d GROUP BY u")
def idempotent_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.latest(arrivals(spark, sf_dir).select("u", "k", "value", "seq"), ["u"], "seq").drop("writes")


KILL, SAVED = 6000, 4500


def rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sink gets from a run that fails at KILL and one that goes on from what was saved at SAVED."""
    rows = keyed.running_total(arrivals(spark, sf_dir), ["u"], F.col("value")).select("u", "running", "seq")
    first = source.until(rows, KILL).withColumn("attempt", F.lit(1))
    return first.unionByName(source.replay(rows, SAVED).withColumn("attempt", F.lit(2)))


@query(f"WITH {DIS} SELECT u, count(*) FILTER (WHERE seq < {KILL}) + count(*) FILTER (WHERE seq >= {SAVED}) AS writes FROM d GROUP BY u")
def upsert_write_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.latest(rerun(spark, sf_dir), ["u"], "seq").select("u", "writes")


@query(f"WITH {DIS} SELECT u, CAST(sum(value) AS BIGINT) AS total FROM d GROUP BY u")
def recovery_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.latest(rerun(spark, sf_dir), ["u"], "seq").select("u", F.col("running").alias("total"))


@query(f"WITH {DIS} SELECT u, count(*) + count(*) FILTER (WHERE seq >= {SAVED} AND seq < {KILL}) AS n FROM d GROUP BY u")
def append_double_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negative control: a sink that appends counts what is replayed twice."""
    return rerun(spark, sf_dir).groupBy("u").agg(F.count("*").alias("n"))


# Reports.


@query(f"WITH {EV}, h AS ({simple('ev', floor('event_ms', HOUR), HOUR, 'k', 'sum(value)', 'total')}) SELECT k, window_start_ms, total FROM h ORDER BY total DESC, k, window_start_ms LIMIT 8")
def topk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(tumbling_sum_keyed(spark, sf_dir).select("k", "window_start_ms", "total"), 8, F.desc("total"), F.col("k"), F.col("window_start_ms"))


@query(f"""WITH {EV} SELECT event_id,
    CASE WHEN value - 5000 < 0 THEN '-' ELSE '' END || '$' || CAST(abs(value - 5000) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(value - 5000) % 100 AS VARCHAR), 2, '0') AS money,
    lpad(CAST((event_ms % 86400000) // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST((event_ms % 3600000) // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST((event_ms % 60000) // 1000 AS VARCHAR), 2, '0') AS clock FROM ev""")
def format_money_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir)
    return rows.select("event_id", formats.money(F.col("value") - 5000).alias("money"), formats.clock(F.col("event_ms") % 86_400_000).alias("clock"))


@query(f"""WITH {EV}, s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM ev), p AS (SELECT unnest([50.0, 90.0, 99.0, 99.9]) AS percent)
SELECT CAST(percent AS DOUBLE) AS percent, value FROM s JOIN p ON i = CAST(floor(CAST(percent AS DOUBLE) / 100 * (n - 1)) AS BIGINT)""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.nearest_rank(ev(spark, sf_dir), "value", [50.0, 90.0, 99.0, 99.9])


@query(f"WITH {EV} SELECT k, CAST(sum(value) AS BIGINT) AS total FROM ev GROUP BY k")
def baseline_group_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).groupBy("k").agg(aggregates.total().alias("total"))
