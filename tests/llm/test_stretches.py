"""Repeated stretches of words that sentences and whole lines don't show."""

from __future__ import annotations

import random
import re

from tests.llm.test_licenses import words
from tidemark.llm import paragraphs, queries

SMALL = "/root/testdata/sf0.001"


def made(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)]


def covered(rows, text, doc_id):
    """Whether each word of the text is in a row of the document."""
    own = [r for r in rows if r.doc_id == doc_id]
    return [any(r.start <= w.start() and w.end() <= r.end for r in own) for w in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text)]


def test_stretches_in_unpunctuated_and_capital_text(spark):
    common, changed = made(60, 1), made(60, 1)
    changed[30] = "other"
    title, lined = made(60, 2), made(60, 3)
    rows = [
        (1, " ".join([*made(80, 10), *common, *made(80, 11)])),
        (2, " ".join([*made(70, 12), *common, *made(90, 13)])),
        (3, " ".join([*made(70, 14), *changed, *made(90, 15)])),
        (4, " ".join([*made(70, 16), *title, *made(70, 17)]).title()),
        (5, " ".join([*made(90, 18), *title, *made(90, 19)]).upper()),
        (6, " ".join([*made(50, 20), *lined, *made(50, 21)])),
        (7, "é " + " ".join([*made(50, 22), *lined[:30]]) + "\n" + " ".join([*lined[30:], *made(50, 23)])),
        (8, " ".join([*made(50, 24), *common[:20], *made(50, 25)])),
    ]
    got = paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {2: (70, 130), 3: (70, 130), 5: (90, 150), 7: (51, 111)}
    for i, text in rows:
        a, b = want.get(i, (0, 0))
        assert covered(got, text, i) == [a <= k < b for k in range(len(words(text)))], i
    assert {(r.doc_id, r.kept_doc_id) for r in got} == {(2, 1), (3, 1), (5, 4), (7, 6)}
    assert all(rows[0][1][r.kept_start :].startswith(common[0]) for r in got if r.kept_doc_id == 1)


def test_all_windows_of_fifty_words_against_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op5_substring_dedup(spark, SMALL).collect()
    seen, tried = set(), 0
    for i, t in sorted(texts.items()):
        w = words(t)
        later = []
        for k in range(len(w) - 49):
            window = tuple(w[k : k + 50])
            if window in seen:
                later.append(k)
            seen.add(window)
        if later:
            inside = covered(got, t, i)
            assert all(all(inside[k : k + 50]) for k in later), i
            tried += len(later)
    assert tried > 100


def test_stretches_within_a_row_and_among_rows_without_id(spark):
    twice, without_id = made(60, 4), made(60, 5)
    rows = [
        (1, " ".join([*made(50, 30), *twice, *made(50, 31), *twice, *made(50, 32)])),
        (None, " ".join([*made(50, 33), *without_id, *made(50, 34)])),
        (None, " ".join([*made(50, 35), *without_id, *made(50, 36)])),
    ]
    got = paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert [(r.doc_id, r.n_words, r.kept_doc_id) for r in sorted(got, key=str)] == [(1, 60, 1), (None, 60, None)]
    assert all(next(t for i, t in rows if i == r.doc_id)[r.start :].startswith((twice[0], without_id[0])) for r in got if r.doc_id)


def test_recall_of_planted_passages(spark):
    """Passages of 51 to 80 words in other words, with and without stops and capitals, equal or with one word changed."""
    rng, rows, want = random.Random(8), [], {}
    for k in range(120):
        own = made(rng.randint(51, 80), 1000 + k)
        if k % 2:
            own = [w.title() if i % 9 == 0 else w + "." * (i % 9 == 8) for i, w in enumerate(own)]
        other = list(own)
        if k % 4 > 1:
            other[rng.randrange(len(other))] = "changed"
        for i, passage in ((2 * k, own), (2 * k + 1, other)):
            before = made(rng.randint(20, 90), 5000 + i)
            rows.append((i, " ".join([*before, *passage, *made(rng.randint(20, 90), 9000 + i)])))
            want[i] = (len(before), len(before) + len(passage))
    got = paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = [0, 0]
    for i, text in rows:
        a, b = want[i]
        inside = covered(got, text, i)
        assert not any(inside[: a - 1]) and not any(inside[b + 1 :])
        if i % 2:
            found[i // 2 % 4 > 1] += sum(inside[a:b]) >= 0.8 * (b - a)
        else:
            assert not any(inside)
    assert found[0] == 60 and found[1] >= 54
