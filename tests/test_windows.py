from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests import simulator
from tidemark.operators import aggregates, sessions, watermarks
from tidemark.operators.windowed import Windowed
from tidemark.operators.windows import Session, Sliding, Tumbling, assign
from tidemark.sources.events import sane, vector

ROW = "k string, value long, event_ms long"


def stream(seed, n=250, keys=4, jitter=150):
    rng, clock, out = random.Random(seed), 0, []
    for _ in range(n):
        clock += 10
        out.append((f"k{rng.randrange(keys)}", rng.randint(-5, 50), clock + rng.randint(-jitter, jitter)))
    return out


@pytest.mark.parametrize(("seed", "windows", "bound", "lateness"), [(1, Tumbling(100), 60, 0), (2, Tumbling(70), 40, 90), (3, Sliding(120, 50), 30, 60), (4, Sliding(40, 90), 50, 20)])
def test_emissions_and_late_rows_match_the_rules(spark, seed, windows, bound, lateness):
    rows = stream(seed)
    cells = (lambda ms: simulator.tumbling(ms, windows.size)) if isinstance(windows, Tumbling) else (lambda ms: simulator.sliding(ms, windows.size, windows.slide))
    emissions, late, marks = simulator.simulate(rows, cells, windows.size, bound, lateness)
    w = Windowed(vector(spark, rows, ROW), ("k",), windows, bound, lateness)
    got = w.emissions().collect()
    end = lambda seq: -1 if seq is None else seq
    assert sorted((r.k, r.window_start_ms, r.window_end_ms, r.value, end(r.fire_seq)) for r in got) == sorted((*e[:4], end(e[4])) for e in emissions)
    assert sorted(r.seq for r in w.late().collect()) == late
    last = {(k, s): v for k, s, _, v, _ in emissions}
    assert {(r.k, r.window_start_ms): r.total for r in w.final(total=aggregates.total()).collect()} == last
    seen = watermarks.exact(w.rows, bound).where("advance").select("seq", "wm_after").collect()
    assert sorted(map(tuple, seen)) == marks


def test_tumbling_before_the_epoch(spark):
    got = assign(vector(spark, [(-1,), (-5000,), (-5001,), (7300,)], "event_ms long"), Tumbling(5000))
    assert {(r.event_ms, r.window_start_ms) for r in got.collect()} == {(-1, -5000), (-5000, -5000), (-5001, -10000), (7300, 5000)}


def test_sliding_counts(spark):
    rows = vector(spark, [(7000,), (5000,)], "event_ms long")
    assert assign(rows.where("event_ms = 7000"), Sliding(5000, 1000)).count() == 5
    assert {r.window_start_ms for r in assign(rows.where("event_ms = 5000"), Sliding(4000, 2000)).collect()} == {4000, 2000}
    assert assign(vector(spark, [(50,), (5,)], "event_ms long"), Sliding(10, 40)).collect()[0].event_ms == 5


def test_lateness_re_emits_the_corrected_value(spark):
    rows = [("a", 10, 100), ("a", 0, 1000), ("a", 5, 200), ("a", 0, 1500), ("a", 0, 4000), ("a", 7, 300)]
    w = Windowed(vector(spark, rows, ROW), ("k",), Tumbling(1000), 0, 2000)
    first = [(r.value, r.event_ms) for r in w.emissions().where("window_start_ms = 0").orderBy("emission").collect()]
    assert first == [(10, 999), (15, 999)]
    assert [r.value for r in w.late().collect()] == [7]


def test_sessions_bridge_and_part_at_an_exact_gap(spark):
    rows = [("n", v, t) for t, v in ((0, 1), (5000, 2), (900, 4), (1800, 8), (2700, 16), (3600, 32), (4500, 64))] + [("e", 1, 0), ("e", 2, 1000)]
    got = sessions.sessions(vector(spark, rows, ROW), ["k"], Session(1000), total=aggregates.total()).collect()
    assert {(r.k, r.window_start_ms, r.window_end_ms, r.total) for r in got} == {("n", 0, 6000, 127), ("e", 0, 1000, 1), ("e", 1000, 2000, 2)}


@pytest.mark.parametrize("gap", [1, 15, 40])
def test_sessions_match_the_rules(spark, gap):
    rows = stream(7, n=300)
    got = sessions.sessions(vector(spark, rows, ROW), ["k"], Session(gap), total=aggregates.total()).collect()
    assert sorted((r.k, r.window_start_ms, r.window_end_ms, r.total) for r in got) == sorted(simulator.sessions(rows, gap))
    marked = sessions.islands(vector(spark, rows, ROW), ["k"], Session(gap)).groupBy("k", "window_start_ms").agg(F.sum("value").alias("t")).collect()
    assert sorted(map(tuple, marked)) == sorted((k, s, t) for k, s, _, t in simulator.sessions(rows, gap))


def test_least_watermark_of_channels(spark):
    rows = [(0, 5000), (1, 1000), (1, 900), (0, 6000), (1, 7000)]
    got = watermarks.min_across(vector(spark, rows, "channel int, wm_ms long"), "channel", 2)
    assert sorted(map(tuple, got.collect())) == [(1, 1000), (4, 6000)]


def test_far_off_times_go_before_the_watermark(spark):
    rows = vector(spark, [("a", 1, 100), ("a", 1, 4 * 10**12), ("a", 1, 200)], ROW)
    kept = Windowed(sane(rows, 0, 10**12), ("k",), Tumbling(1000), 0)
    assert kept.late().count() == 0 and kept.final(n=aggregates.count()).first().n == 2
    assert Windowed(rows, ("k",), Tumbling(1000), 0).late().count() == 1  # the control


def test_no_rows(spark):
    none = vector(spark, [], ROW)
    w = Windowed(none, ("k",), Tumbling(1000), 0)
    assert w.emissions().count() == w.late().count() == w.final(n=aggregates.count()).count() == 0
    with pytest.raises(ValueError, match="positive"):
        Tumbling(0)
