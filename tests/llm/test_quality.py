from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality, queries

MIDDLE = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score string, quality int"


def test_held_out_accuracy(spark):
    got = queries.op2_quality(spark, MIDDLE)
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    met = got.where("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    assert len(met) > 50
    assert np.mean([r.predicted == r.quality for r in met]) > 0.93
    kept = [r.predicted for r in met if r.quality == 1]
    assert np.mean(kept) > 0.97
    all_ = got.collect()
    assert len(all_) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in all_)


def brute_scores(taught, labels, texts):
    """The whole operator again: terms by dictionaries, a full decomposition, votes one by one."""
    marks = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
    bits = quality.TERMS.bit_length() - 1

    def place(value):
        return (value ^ value >> 15) * 2654435761 % 2**32 >> 32 - bits

    def kind(b):
        if b > 127:
            return 5
        if b < 33 or b == 127:
            return int(b != 32)
        return 4 if chr(b).isdigit() else 3 if chr(b).isupper() else 2 if chr(b).islower() else 6 + marks.index(b)

    def terms(text):
        counts = np.zeros(2 * quality.TERMS + 2)
        kinds, n = [kind(b) for b in text], 6 + len(marks)
        for a, b, c in zip(kinds, kinds[1:], kinds[2:], strict=False):
            counts[place((a * n + b) * n + c)] += 1
        for w in re.findall(rb"[^\x00-\x20]+", text):
            letters = [b + 32 if 65 <= b <= 90 else b for b in w]
            counts[quality.TERMS + place(sum((b * 2654435761 % 2**32 | 1) * (i * 0x9E3779B1 + 1) for i, b in enumerate(letters)) % 2**32)] += 1
        tokens, rows = text.split(), text.split(b"\n")
        counts[-2] = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) * len(text) / max(1, len(tokens))
        counts[-1] = sum(map(len, rows)) - sum(map(len, set(rows)))
        return counts

    x = np.array([terms(t) for t in taught])
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    spread = [np.sqrt(c / max(1, c.sum())) * weight for c in x]
    axes = np.linalg.svd(np.array(spread), full_matrices=False)[2][: quality.DIMS]

    def vector(c):
        v = axes @ (np.sqrt(c / max(1, c.sum())) * weight)
        return v / max(np.linalg.norm(v), 1e-9)

    known, out = [vector(c) for c in x], []
    for t in texts:
        own = vector(terms(t))
        near = sorted(((float(own @ v), -k) for k, v in enumerate(known)), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(c, 0) ** quality.POWER, labels[-k]) for c, k in near]
        total = sum(v for v, _ in votes)
        out.append(sum(v * y for v, y in votes) / total if total else np.mean(labels))
    return np.array(out)


def test_scores_against_brute_force(spark):
    found = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("text").distinct().orderBy("text").collect()
    texts = [(r.text or "").encode() for r in found[::3]]
    taught, rest = texts[:60], texts[60:120]  # so few that the operator's axes are exact
    counts = np.array([quality.terms(t) for t in taught])
    order = np.lexsort(counts.T[::-1])  # as the operator sorts them
    labels = [float(k % 3 > 0) for k in range(60)]
    model = quality.latent(counts, np.array(labels))
    got = model.scores(np.array([quality.terms(t) for t in rest]))
    want = brute_scores([taught[k] for k in order], [labels[k] for k in order], rest)
    assert len(np.unique(counts, axis=0)) == 60 and len(rest) == 60
    assert np.mean(np.abs(got - want) < 0.001) > 0.95  # equally near texts aside


def test_votes_against_brute_force_and_whatever_the_batch():
    rng = np.random.default_rng(5)
    counts = rng.poisson(0.02, (400, 2 * quality.TERMS + 2)).astype(np.float32)
    labels = rng.integers(0, 2, 300).astype(float)
    model = quality.latent(counts[:300], labels)
    got = model.scores(counts[300:])
    assert got.tolist() == [float(model.scores(c[None])[0]) for c in counts[300:]]
    vectors = [[int(x) for x in v] for v in model.vectors]
    for k, z in enumerate(model.project(counts[300:330])):
        products = [sum(int(a) * b for a, b in zip(z, v, strict=True)) for v in vectors]
        near = sorted(range(len(vectors)), key=lambda i: (-products[i], i))[: quality.NEIGHBOURS]
        votes = [max(products[i] / quality.FINE**2, 0) ** quality.POWER for i in near]
        assert abs(got[k] - sum(v * model.labels[i] for v, i in zip(votes, near, strict=True)) / sum(votes)) < 2e-6


def test_odd_rows(spark):
    rows = [(1, None, "a", 1), (2, "", "a", None), (3, "Good text of some words.", None, None), (3, "Good text of some words.", None, None), (None, "x", None, None), (4, "word " * 400_000, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (5, None), (None, 1), (9, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3, 3, 4]
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 3}) == 1
    assert quality.score(docs.limit(0), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert np.array_equal(a.labels, b.labels) and len(a.labels) <= quality.SAMPLE
