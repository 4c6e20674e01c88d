from __future__ import annotations

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x.isoformat() if isinstance(x, datetime.datetime) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([plain(r[i]) for i in order]) for r in data)


def check(spark, name, f, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    df = f(spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", [n for n in catalog.SQL if n != "stream_tws_lateness"])
def test_query_matches_sql(spark, name):
    check(spark, name, catalog.QUERIES[name], catalog.SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert catalog.FLAGSHIP in entry.queries() and catalog.SQL.keys() <= entry.oracle_sql().keys()
