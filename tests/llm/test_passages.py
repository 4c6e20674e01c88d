"""Repeated paragraphs, benchmark passages and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_licenses import words
from tests.llm.test_pii import brute as brute_pii
from tests.llm.test_simhash import brute_classes, brute_fingerprint
from tidemark.llm import decontaminate, paragraphs, quality, queries

SMALL = "/root/testdata/sf0.001"


def brute_hits(text, items, width=10):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        own = words(t)
        n = min(width, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(w) - n + 1):
            if grams and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), found


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def test_decontamination_query_against_brute_force(spark):
    items = [tuple(r) for r in table(spark, "benchmark").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op10_decontaminate(spark, SMALL).collect()}
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        n, hit, found = brute_hits(t, items)
        joined = ",".join(sorted(map(str, found)))
        assert tuple(got[i]) == (i, n, hit, len(found), hashlib.sha256(joined.encode()).hexdigest(), hit > 0)
    assert any(r.contaminated for r in got.values())


def test_decontamination_in_one_pass_and_in_several(spark):
    items = [(1, "one two three"), (2, "Ä b c d e f g h i j k l m"), (3, None), (4, ""), (5, "x"), (1, "one two three"), (None, "q"), (6, "c d e f g h i j k l")]
    rows = [(1, "ONE, two: three one two three"), (2, "a Ä-b c d e f g h i j k l m n"), (3, None), (4, "  "), (5, "😀 x x y x"), (5, "😀 x x y x"), (6, "one two q"), (None, "x")]
    docs = spark.createDataFrame([(*r, "z", "z") for r in rows], "doc_id long, text string, n_hit string, item_id string")
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, doc_id string")
    known = [(i, t) for i, t in items if i is not None]
    for most in (decontaminate.MAX_WINDOWS, 2):
        got = decontaminate.contamination(docs, bench, max_windows=most).collect()
        want = [(i, *brute_hits(t, known)) for i, t in rows]
        assert sorted(str((r.doc_id, r.n_words, r.n_hit, set(r["items"]))) for r in got) == sorted(map(str, want))
        by_id = {r.doc_id: r for r in got}
        text = rows[1][1]
        assert [text[h.start : h.end] for h in by_id[2].hits] == ["Ä-b c d e f g h i j k l m"]
        assert [(h.start, h.end) for h in by_id[5].hits] == [(2, 5), (8, 9)]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}


def test_a_benchmark_of_many_windows_is_one_scan(spark):
    rng = np.random.default_rng(5)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 60_000, 209))) for k in range(1000)]
    rows = [(k, " ".join([f"x{i}" for i in range(k)] + items[7 * k][1].split()[k : k + 12]) + ("" if k else " y" * 300_000)) for k in range(20)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r.doc_id: r for r in found.collect()}
    for k, t in rows:
        assert (got[k].n_words, got[k].n_hit, got[k]["items"]) == (len(t.split()), 12, [7 * k])
        assert [t[h.start : h.end] for h in got[k].hits] == [" ".join(items[7 * k][1].split()[k : k + 12])]


def brute_paragraphs(texts, least):
    found = []
    for i, t in sorted(texts.items()):
        start = 0
        for line in (t or "").split("\n"):
            w = words(line)
            if len(w) >= least:
                n = min(5, len(w))
                found.append((i, start, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}))
            start += len(line) + 1
    same = [{(i, p)} for i, p, _ in found]
    at = {f[:2]: k for k, f in enumerate(found)}
    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][2], found[b][2]
            if same[a] is not same[b] and len(x & y) >= 0.8 * len(x | y):
                same[a] |= same[b]
                for place in list(same[b]):
                    same[at[place]] = same[a]
    return {(*place, *min(c)) for c in same for place in c if place != min(c)}


def test_repeated_passages_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    got = queries.op5_substring_dedup(spark, SMALL).collect()
    assert {(r.doc_id, r.start, r.kept_doc_id, r.kept_start) for r in got if r.unit == "paragraph"} == brute_paragraphs(texts, queries.REPEATED_WORDS)
    first = {}
    for i, t in sorted(texts.items()):
        first.setdefault(t, i)
    whole = {(i, 0, len(t), first[t]) for i, t in texts.items() if first[t] != i and len(words(t)) >= queries.REPEATED_WORDS}
    assert {(r.doc_id, r.start, r.end, r.kept_doc_id) for r in got if r.unit == "text"} == whole and whole
    for r in got:
        assert len(words(texts[r.doc_id][r.start : r.end])) == r.n_words


def test_short_lines_are_found(spark):
    """The operator itself takes any line of a shingle's words; its query has a parameter."""
    texts = {r.doc_id: "\n".join((r.text or "").split("\n")[:2]) for r in table(spark, "documents").limit(80).collect()}
    made = "one line of just these twelve words is found wherever it stands"
    texts |= {1001: f"x y\n{made}\nz", 1002: f"{made.title()}!", 1003: made.replace("wherever", "anywhere")}
    got = paragraphs.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.kept_doc_id, r.kept_start) for r in got if r.unit == "paragraph"} == brute_paragraphs(texts, paragraphs.LEAST_WORDS)
    assert (1002, 0, 1001, 4) in {(r.doc_id, r.start, r.kept_doc_id, r.kept_start) for r in got}


def test_repeated_passages_odd_rows(spark):
    w = [f"w{i}" for i in range(60)]
    near = " ".join([*w[:30], "changed", *w[31:]])
    far = " ".join(w[:20] + [f"v{i}" for i in range(40)])
    text, long = " ".join(w), " ".join(f"l{i}" for i in range(60_000))
    rows = [(1, f"é\n{text}"), (2, text.upper() + "!\nshort"), (3, near), (4, far), (5, None), (6, ""), (7, text), (7, text), (None, text), (8, f"{text}\n{text}"), (9, "ä b"), (10, "Ä b"), (11, long), (12, f"before {long}"), (13, "again " * 500), (14, " \n")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, pos int").coalesce(1)
    got = paragraphs.repeats(docs).collect()
    lines = [(r.doc_id, r.start, r.kept_doc_id) for r in got if r.unit == "paragraph"]
    assert sorted(map(str, lines)) == sorted(map(str, [(1, 2, None), (2, 0, None), (3, 0, None), (7, 0, None), (7, 0, None), (8, 0, None), (8, len(text) + 1, None), (12, 0, 11)]))
    assert sorted((r.doc_id, r.start, r.end, r.n_words) for r in got if r.unit == "text") == [(7, 0, len(text), 60)] * 2
    inside = {(r.doc_id, r.start, r.end) for r in got if r.unit == "stretch"}
    assert {(12, 7, 7 + len(long)), (13, 6, 2999)} <= inside
    assert {r.doc_id for r in got} == {1, 2, 3, 7, 8, 12, 13}
    assert paragraphs.repeats(docs.limit(0)).count() == 0


def test_bands_recall():
    rng = np.random.default_rng(9)
    met = tried = 0
    for _ in range(400):
        w = [b"%d" % x for x in rng.integers(0, 10**6, 80)]
        v = [*w]
        v[int(rng.integers(0, 80))] = b"new"
        a, b = (set(paragraphs.shingles(t)) for t in (w, v))
        if len(a & b) / len(a | b) >= 0.8:
            tried += 1
            x, y = (paragraphs.bands(paragraphs.hashed(b" ".join(t))[2], np.array([0]), np.array([80]))[0] for t in (w, v))
            met += bool((x == y).any())
    assert tried > 300 and met >= 0.98 * tried


def test_a_crowd_of_lines_in_one_bucket():
    """More members than a block has, in pairs of blocks: what's similar is joined, and nothing else."""
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") * 3 + str(rng.randrange(40)) for _ in range(30)] for _ in range(12)]
    members = []
    for k in range(60):
        w = list(base[k % 12])
        w[rng.choice((0, 29))] = f"n{k}"
        members.append((k, k, k % 2, " ".join(w).encode()))
    found = [x for i, j in ((0, 0), (0, 1), (1, 1)) for x in paragraphs.links([m for m in members if m[2] in (i, j)], i, j, 0.8)]
    head = list(range(60))
    for _ in range(60):
        for a, b in found:
            head[a] = head[b] = min(head[a], head[b])
    sets = [set(paragraphs.shingles(m[3].split(b" "))) for m in members]
    want = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(a):
                if paragraphs.similar(sets[a], sets[b], 0.8):
                    want[a] = want[b] = min(want[a], want[b])
    assert head == want and len(set(want)) < 60


def test_pipeline_against_brute_force(spark):
    docs = table(spark, "documents")
    model = quality.fit(docs, table(spark, "labels"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= 0.7}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    classes = brute_classes({i: brute_fingerprint(t) for i, t in texts.items()})
    items = [tuple(r) for r in table(spark, "benchmark").select("item_id", "text").collect()]
    kept = {i: t for i, t in texts.items() if classes[i] == i and not brute_hits(t, items)[1]}
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in kept.items():
        runs = []
        for s in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in brute_pii(t))):
            if runs and s[0] < runs[-1][1]:
                runs[-1] = (runs[-1][0], max(runs[-1][1], s[1]), runs[-1][2])
            else:
                runs.append(s)
        for a, b, kind in reversed(runs):
            t = f"{t[:a]}<{kind.upper()}>{t[b:]}"
        want[i] = own.encode(t, add_special_tokens=False).ids
    got = {r.doc_id: np.frombuffer(bytes(r.ids), dtype="<u4").tolist() for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want and len(corpus_pipeline.STAGES) == 5
    assert any(re.search("<(EMAIL|IP|CARD|PHONE)>", own.decode(ids)) for ids in got.values())


def test_pipeline_stages_on_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (1, None, "en", "a", 0), (2, "", None, None, None), (3, "some words here", "en", "b", 15), (None, "other words", "en", "b", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    deduped = corpus_pipeline.one_of_each_group(spark, docs, SMALL)
    assert sorted(str(r.doc_id) for r in deduped.collect()) == ["1", "3", "None"]
    clean = corpus_pipeline.decontaminated(spark, docs, SMALL)
    assert clean.count() == 5 and clean.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.redacted(spark, docs, SMALL).columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.tokens(spark, docs, SMALL).count() == 5
    assert corpus_pipeline.good_quality(spark, docs, SMALL).columns == corpus_pipeline.COLUMNS
