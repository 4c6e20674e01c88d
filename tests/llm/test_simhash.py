from __future__ import annotations

import random
import re

import xxhash

from tidemark.llm import queries, simhash
from tidemark.llm.components import components

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, fp string, component string"


def brute_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def brute_classes(fps: dict[int, int], most: int = 4) -> dict[int, int]:
    head = {i: i for i in fps}

    def find(i: int) -> int:
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = {(i, f"{fps[i]:016x}", c) for i, c in brute_classes(fps).items()}
    got = [tuple(r) for r in queries.op3_simhash_dedup(spark, SMALL).collect()]
    assert len(got) == len(want) and set(got) == want


def test_links_between_planted_fingerprints(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
    fps |= {0, (1 << 64) - 1, 1 << 63, 0b1111, 0b11111 << 40}
    by_id = dict(enumerate(sorted(fps)))
    want = brute_classes(by_id)
    found = simhash.clusters(spark.createDataFrame([(signed(f),) for f in by_id.values()], "fp long")).collect()
    ids = {signed(f): i for i, f in by_id.items()}
    groups: dict[int, set[int]] = {}
    for r in found:
        groups.setdefault(r.component, set()).add(ids[r.fp])
    wanted: dict[int, set[int]] = {}
    for i, c in want.items():
        wanted.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(120_000))
    rows = [(1, None, "x", "y"), (2, "", "x", None), (3, " \t", None, None), (4, "One two", None, None), (5, "one  TWO", None, None), (5, "one  TWO", None, None), (None, "one two", None, None), (6, long, None, None)]
    got = sorted(simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect(), key=str)
    assert len(got) == len(rows)
    classes = {(r.doc_id, r.component_id) for r in got}
    assert classes == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4), (6, 6)}
    assert {r.fp for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert next(r.fp for r in got if r.doc_id == 6) == signed(brute_fingerprint(long))
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (7, 6), (None, 3)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)}
