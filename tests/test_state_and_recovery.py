from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests import simulator
from tidemark.functions import formats, keygroups
from tidemark.operators import aggregates, keyed, ranking
from tidemark.operators.scan import max_before, next_at_least, numbered
from tidemark.operators.windows import Session, Sliding, Tumbling
from tidemark.sources.events import replay, until, vector
from tidemark.streaming.lateness import late_windows
from tidemark.streaming.run import FLUSH, SCHEMA, Append, Setting, Upsert, feed, run, run_failing, shared_folder, stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_running_totals(spark):
    rows = vector(spark, [("midtown", 10), ("queens", 3), ("midtown", 5), ("queens", 4)], "k string, value long")
    got = keyed.running(rows, ["k"], F.sum("value")).orderBy("seq").collect()
    assert [r.running for r in got] == [10, 3, 15, 7]


def test_unset_is_not_zero(spark):
    rows = vector(spark, [("a", 0), ("a", 7)], "k string, value long")
    assert [r.held for r in keyed.last_value(rows, ["k"], "value").orderBy("seq").collect()] == [None, 0]


def test_lists_and_collected_values_keep_arrival_order(spark):
    rows = vector(spark, [("user-1", "home"), ("user-2", "checkout"), ("user-1", "search")], "k string, value string").repartition(3)
    assert {r.k: r.list for r in keyed.history(rows, ["k"], "value").collect()} == {"user-1": ["home", "search"], "user-2": ["checkout"]}
    assert {r.k: r.c for r in rows.groupBy("k").agg(aggregates.collect().alias("c")).collect()} == {"user-1": ["home", "search"], "user-2": ["checkout"]}


def test_key_groups(spark):
    names = spark.createDataFrame([("midtown",), ("brooklyn",), ("queens",), (None,)], "k string")
    got = {r.k: r.g for r in names.select("k", keygroups.group_of(F.col("k")).alias("g")).collect()}
    assert got == {"midtown": 68, "brooklyn": 43, "queens": 92, None: None}
    for p in range(1, 129):
        owner = [g * p // 128 for g in range(128)]
        assert [s for s in range(p) for _ in range(*keygroups.range_for(s, p))] == owner


def test_scans_over_several_buckets(spark):
    values = [(i * 37) % 101 for i in range(101)]
    rows = vector(spark, [(v,) for v in values], "value long")
    got = max_before(rows, "seq", {"m": F.col("value")}, 7).orderBy("seq").collect()
    assert [r.m for r in got] == [max(values[:i], default=None) for i in range(101)]
    assert [r.value for r in numbered(rows, ["value"], "n").orderBy("n").collect()] == sorted(values)
    wanted = spark.createDataFrame([(x,) for x in (-5, 0, 33, 50, 99, 100, 101)], "x long")
    met = next_at_least(wanted, "x", rows.where("value % 10 = 0"), "value", "value", "y", 13)
    assert {r.x: r.y for r in met.collect()} == {-5: 0, 0: 0, 33: 40, 50: 50, 99: 100, 100: 100, 101: None}


def test_hot_keys_and_keyed_scans_in_parts(spark):
    rows = vector(spark, [("hot" if i % 3 else None if i % 2 else f"k{i % 7}", i * 7 % 23 - 5) for i in range(400)], "k string, value long")
    want, totals, tops = {}, {}, {}
    for r in rows.orderBy("seq").collect():
        want[r.seq] = (totals[r.k] if (before := tops.get(r.k)) is None and r.k in totals else before, totals.setdefault(r.k, 0) + r.value)
        totals[r.k] += r.value
        tops[r.k] = r.value if before is None else max(before, r.value)
    got = {r.seq: r.running for r in keyed.running_total(rows, ["k"], F.col("value"), hot=40).collect()}
    assert got == {i: t for i, (_, t) in want.items()}
    got = {r.seq: r.m for r in max_before(rows, "seq", {"m": F.col("value")}, 50, ("k",)).collect()}
    assert got == {i: m for i, (m, _) in want.items()}
    assert [r.seq for r in numbered(rows.withColumn("at", F.when(F.col("seq") > 5, F.col("seq") * 3 % 400)), ["at", "seq"], "n", 30).orderBy("n").collect()][:6] == list(range(6))


class Joined(aggregates.Aggregator):
    """Order matters here, so a wrong merge would show."""

    def create(self):
        return ""

    def add(self, acc, value):
        return f"{acc}{value},"

    def merge(self, a, b):
        return a + b

    def result(self, acc):
        return acc.rstrip(",")


def test_user_defined_aggregates_merge_parts_in_order(spark):
    rows = vector(spark, [("a" if i % 4 else "b", i) for i in range(50)], "k string, value long").repartition(3)
    got = {r.k: r.result for r in aggregates.aggregated(rows, ["k"], Joined(), "string", part=7).collect()}
    assert got == {k: ",".join(str(i) for i in range(50) if bool(i % 4) == (k == "a")) for k in "ab"}
    assert aggregates.aggregated(rows.limit(0), ["k"], Joined(), "string").count() == 0


def test_percentiles_by_nearest_rank(spark):
    rows = spark.createDataFrame([(v,) for v in (5, 1, 4, 2, 3)], "v long")
    assert sorted(map(tuple, ranking.nearest_rank(rows, "v", [0, 50, 99, 100]).collect())) == [(0.0, 1), (50.0, 3), (99.0, 4), (100.0, 5)]
    assert ranking.nearest_rank(rows.limit(0), "v", [50]).count() == 0


def test_formats(spark):
    rows = spark.createDataFrame([(1205, 3_723_000), (-7, -61_000), (0, 360_000_000)], "c long, ms long")
    got = [tuple(r) for r in rows.select(formats.money(F.col("c")), formats.clock(F.col("ms"))).collect()]
    assert got == [("$12.05", "01:02:03"), ("-$0.07", "-00:01:01"), ("$0.00", "100:00:00")]


def test_upsert_after_replay_and_the_append_control(spark):
    rows = keyed.running(vector(spark, [(f"z{i % 5}", 1) for i in range(100)], "k string, value long"), ["k"], F.sum("value")).select("k", "running", "seq")
    writes = until(rows, 60).unionByName(replay(rows, 45))
    assert {r.k: r.running for r in keyed.latest(writes, ["k"], "seq").collect()} == {f"z{i}": 20 for i in range(5)}
    assert writes.count() == 115


@pytest.fixture
def trips(spark):
    return vector(spark, [(f"z{i % 5}", i % 3, 1, i * 10) for i in range(100)], "k string, u long, value long, event_ms long")


def totals(df):
    return df.groupBy("k").agg(F.sum("value").alias("total"))


@pytest.mark.parametrize("partitions", ["4", "1"])
def test_a_failed_batch_comes_again(spark, trips, partitions):
    folder = shared_folder(spark)
    feed(trips, f"{folder}/in", 4)
    rows = stream(spark, f"{folder}/in", 0)
    said = run_failing(totals(rows), Upsert(f"{folder}/out", ["k"], fail_at=2), f"{folder}/checkpoint", "update")
    assert "told to fail after writing batch 2" in said
    with Setting(spark, "spark.sql.shuffle.partitions", partitions):
        run(totals(rows), sink := Upsert(f"{folder}/out", ["k"]), f"{folder}/checkpoint", "update")
    assert {r.k: r.total for r in sink.read(spark).collect()} == {f"z{i}": 20 for i in range(5)}
    assert Append(f"{folder}/out", []).read(spark).count() > 5  # the control: more was delivered than there are keys


class Listed(aggregates.Total):
    """Values in order of arrival, so that a value lost, doubled or merged in another order would show."""

    def create(self):
        return ()

    def add(self, acc, value):
        return (*acc, value)

    def result(self, acc):
        return ",".join(map(str, acc))

    fold = aggregates.Aggregator.fold


LATER = 1_000_000_000_000

STREAMED = [  # batches of (key, value, event_ms less LATER); the watermark is the highest time of earlier batches
    [("a", 1, 100), ("b", 2, 999), ("a", 3, 1000)],  # nothing is late in the first batch
    [("a", 4, 500), ("b", 5, 1999), ("a", 6, 2000)],  # into a window that fires with this batch
    [("a", 7, 999), ("a", 8, 1999), ("b", 9, 2999), ("a", 10, 3000)],  # corrections
    [("a", 11, 999), ("b", 12, 1500), ("a", 13, 1000), ("c", 14, 7000)],  # the first is late: its window ended lateness ago
    [("a", 15, 3999), ("c", 16, 5000), ("c", 17, 5999), ("b", 18, 9000)],
    [("c", 19, 6500), ("a", 20, 9000)],
]
STREAMED = [[(k, v, LATER + ms) for k, v, ms in rows] for rows in STREAMED]


def by_batch(windows, gap, lateness, flush):
    """What comes out, by plain rules: a batch's rows go in under the watermark of the batches before it, then windows fire."""
    held, out, top = {}, [], None
    for rows in [*STREAMED, [(None, 0, flush)], [(None, 0, flush + 1)]]:
        wm, touched = top, set()
        for cell in [c for c in held if wm is not None and c[2] + lateness <= wm]:
            if held[cell][1]:
                out.append((*cell, held[cell][0], False))
            del held[cell]
        for key, value, ms in rows:
            taken = False
            for start, end in windows(ms):
                if key is None or (wm is not None and end + lateness <= wm):
                    continue
                taken, cell, acc = True, (key, start, end), (value,)
                if gap:
                    near = sorted(c for c in held if c[0] == key and c[1] < end and start < c[2])
                    parts = sorted([(c[1], c[2], held.pop(c)[0]) for c in near] + [(start, end, acc)], key=lambda x: x[:2])
                    cell, acc = (key, parts[0][0], max(p[1] for p in parts)), tuple(v for p in parts for v in p[2])
                elif cell in held:
                    acc = (*held[cell][0], value)
                held[cell] = (acc, True)
                touched.add(cell)
            if not taken and key is not None:
                out.append((key, ms, None, (value,), True))
        for cell, (acc, dirty) in list(held.items()):
            if dirty and wm is not None and cell[2] <= wm:
                out.append((*cell, acc, False))
                held[cell] = (acc, False)
        top = max([ms for *_, ms in rows] + ([top] if top is not None else []))
    out += [(*c, acc, False) for c, (acc, dirty) in held.items() if dirty]
    return out


def check_log(spark, windows, lateness, fail_at=()):
    """The log of a run, which the sink stops after it has written each of the batches fail_at, against the rules.

    Sessions compare values as a set, since rows of a batch join each other first.
    """
    folder, merging = shared_folder(spark), isinstance(windows, Session)
    n = 0
    for rows in STREAMED:
        made = [(n + i, key, 0, value, ms) for i, (key, value, ms) in enumerate(rows)]
        n += len(rows)
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    feed(spark.createDataFrame([], SCHEMA), f"{folder}/in", 1, flush_ms=LATER + 100_000)
    with Setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKS):
        source = stream(spark, f"{folder}/in", 50_000).select("seq", "k", "u", "value", "event_ms", "ts")
        found = late_windows(source, ["k", "u"], windows, Listed(), "string", 0, lateness, 50_000)
        for batch in fail_at:
            assert f"batch {batch}" in run_failing(found, Append(f"{folder}/out", [], fail_at=batch), f"{folder}/checkpoint", "update")
        run(found, sink := Append(f"{folder}/out", []), f"{folder}/checkpoint", "update")
    got = []
    for r in sink.read(spark).where(F.col("k") != FLUSH).collect():
        got.append((r.k, r.event_ms, None, (r.value,), True) if r.is_late else (r.k, r.window_start_ms, r.window_end_ms, tuple(map(int, r.result.split(","))), False))
    starts = (lambda ms: [(ms, ms + 1000)]) if merging else (lambda ms: [(s, s + windows.size) for s in simulator.sliding(ms, windows.size, getattr(windows, "slide", windows.size))])
    want = by_batch(starts, 1000 if merging else 0, lateness, LATER + 100_000)
    plain = (lambda x: (*x[:3], tuple(sorted(x[3])), x[4])) if merging else (lambda x: x)
    assert sorted(map(str, map(plain, got))) == sorted(map(str, map(plain, want)))


@pytest.mark.parametrize("windows,lateness", [(Tumbling(1000), 1000), (Tumbling(1000), 0), (Sliding(2000, 1000), 500), (Sliding(500, 1000), 500), (Session(1000), 0), (Session(1000), 1500)])
def test_stateful_windows_emit_what_the_rules_say(spark, windows, lateness):
    check_log(spark, windows, lateness)


def test_stateful_windows_go_on_after_each_failure(spark):
    check_log(spark, Tumbling(1000), 1000, fail_at=range(1, 6))
