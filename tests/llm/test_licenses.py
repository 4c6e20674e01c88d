from __future__ import annotations

import re

from tidemark.llm import licenses, queries
from tidemark.llm.licenses import NOTICES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words string, spans string"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def base(w: list[str]) -> list[tuple[int, str]]:
    out = []
    for n in NOTICES:
        p = n.phrase.split()
        if n.base:
            out += [(i, n.label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return out


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def fuzzy_labels(w: list[str]) -> set[str]:
    found = set()
    for n in NOTICES:
        p = n.phrase.encode()
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + len(p.split()) + n.errors) + 1):
                part = " ".join(w[i:j]).encode()
                if abs(len(part) - len(p)) <= n.errors and distance(p, part) <= n.errors:
                    found.add(n.label)
    return found


ODD = [
    None, "", "MIT", "The MIT License, the mit license. MIT  licence", "GNU General Public License", "gnu generel publik license",
    "gnu lesser general public license and the gnu general public license v3", "apache licence Apache-License apachelicense",
    "CC BY-NC 4.0 cc-by cc bycc", "permission is hereby grantd, free of charge, to any person obtaining a copy", "mit licens",
    "Redistribution and use in sourse and binary form", "über mit license ümit license", "cc0 1.0 universal", "apache license " * 40,
]


def test_odd_texts_against_brute_force(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(0, None, None, None), (None, "mit license", None, None)]
    got = licenses.notices(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in enumerate(ODD):
        w, r = words(t), by_id[i]
        assert r.n_words == len(w)
        assert sorted((s.first_word, s.label) for s in r.spans if s.base) == sorted(base(w)), t
        assert {s.label for s in r.spans} == fuzzy_labels(w), t
        assert all(0 <= s.first_word < s.end_word <= len(w) and s.errors <= 6 for s in r.spans)
    assert licenses.notices(spark.createDataFrame([], DOCS)).count() == 0


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op1_license_scan(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        w = words(t)
        places = base(w)
        starts = [p for p, _ in places]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not places
    assert sum(r.n_base for r in got.values()) > 0
