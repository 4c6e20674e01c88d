"""Stages of the pipeline decide by row, not by doc_id."""

from __future__ import annotations

import random

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n))


def kept(stage, spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    got = stage(spark, docs, SMALL)
    assert got.columns == corpus_pipeline.COLUMNS
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)


def test_near_duplicates_of_rows_with_null_and_repeated_ids(spark):
    a, b, c, d, e, f = (made(60, k) for k in range(6))
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (7, d), (7, e), (3, e), (9, f), (9, f)]
    want = sorted([(1, a), (None, b), (None, c), (7, d), (3, e), (9, f)], key=str)
    assert kept(corpus_pipeline.one_of_each_group, spark, rows) == want


def test_contaminated_rows_with_null_and_repeated_ids(spark):
    item = next(r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if len((r.text or "").split()) > 12)
    a, b, c = (made(60, k) for k in range(3))
    rows = [(None, a), (None, b), (None, f"{a} {item}"), (5, c), (5, f"{b} {item}")]
    assert kept(corpus_pipeline.decontaminated, spark, rows) == sorted([(None, a), (None, b), (5, c)], key=str)


def test_tokens_decode_to_the_text(spark):
    rows = [(1, "some words, ünd 😀 more  "), (None, ""), (2, "<EMAIL> x"), (2, "other")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.tokens(spark, docs, SMALL).collect()), key=str) == sorted(rows, key=str)
