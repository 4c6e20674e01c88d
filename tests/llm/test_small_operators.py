"""Chat, tokens, top-k and URLs against SQL, the tokenizers library and brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import bpe, chat, queries, topk, urls

SMALL = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def rows(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def sql(name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(r[i] for i in order)) for r in found.fetchall())


def test_chat_query_matches_sql(spark):
    assert rows(queries.op4_chat_format(spark, SMALL)) == sql("op4_chat_format")


def test_chat_odd_rows(spark):
    a, b = ("user", "hi"), ("assistant", "yes")
    logs = {1: [a], 2: [a, b], 3: [a, b, ("user", None)], 4: [a, b, ("user", "")], 5: [b], 6: [b], 7: [(None, "hi")], 8: [("us", "erhi")], 9: [a, b, ("user", "")]}
    turns = [(c, i, r, t, "x", 1) for c, own in logs.items() for i, (r, t) in enumerate(own)] + [(6, 0, *b, "x", 1), (None, 0, "user", "alone", "x", 1)]
    made = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, turns string, n_turns long")
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.render(made).collect()}
    assert got == {3: (3, 1), 4: (3, 2), 5: (1, 2), 7: (1, 1), 8: (1, 1), None: (1, 1)}
    text = {r.conv_id: r.text for r in chat.render(made).collect()}
    assert text[4] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chat.render(made.limit(0)).count() == 0


def test_a_very_long_conversation(spark):
    turns = [(c, i, "user", f"turn {i}") for c, n in ((1, 5000), (2, 4999), (3, 256), (4, 257), (5, 1)) for i in range(n)] + [(6, i, "user", f"turn {i + (i > 300)}") for i in range(512)]
    got = {r.conv_id: r for r in chat.render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert {i: r.n_turns for i, r in got.items()} == {1: 5000, 6: 512}
    assert got[1].text.count("<|im_start|>") == 5000


def test_bpe_query_matches_the_library(spark):
    own = Tokenizer.from_file(BPE)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op7_bpe(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = own.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_texts(spark):
    own = Tokenizer.from_file(BPE)
    texts = [None, "", " ", "  \n\n x", "a<|endoftext|> b<|endoftext|>", "don't  we'll", "\x1c\x1f\x85\u2003é 日本語 😀 ²½ 123", "ab" * 4000, "a" * 3001, "x " * 5000, "\n tab\t end ", "a b  c   d"]
    made = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, "", None), (None, "z", None)], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(made, BPE), BPE).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            want = own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert np.frombuffer(bytes(r.ids), dtype="<u4").tolist() == want and r.n_tokens == len(want)
            assert r.text == (texts[r.doc_id] or "")
    assert bpe.encode(made.limit(0), BPE).count() == 0


def test_bpe_forgets_little_by_little(monkeypatch):
    own, lib = bpe.Tokenizer(BPE), Tokenizer.from_file(BPE)
    monkeypatch.setattr(bpe, "MEMORY", 40)
    rng = np.random.default_rng(7)
    for k in range(30):
        texts = [" ".join("".join(chr(97 + x) for x in rng.integers(0, 5, rng.integers(1, 6))) + "." * (i % 7 == 0) + "5abc " * (i % 9 == 0) for i in range(60)) for _ in range(5)]
        for packed, t in zip(own.encode_batch(texts), texts, strict=True):
            assert np.frombuffer(packed, dtype="<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
        assert k < 3 or own.known.before


def test_bpe_pairs_and_merges_agree():
    own = bpe.Tokenizer(BPE)
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 50_000, (2, 4000))
    for x, y, apart in zip(a.tolist(), b.tolist(), own._apart(a, b).tolist(), strict=True):
        assert apart == (own.merge(own.token[x] + own.token[y]) == [x, y])


def test_bpe_words_side_by_side_are_as_one_by_one():
    own, rng = bpe.Tokenizer(BPE), np.random.default_rng(5)
    texts = ["".join(rng.choice([*"abcdeinorst.é "], n)).strip(" ") or "a" for n in rng.integers(1, 33, 3000)]
    words = [w for w in (t.encode() for t in texts) if len(w) <= bpe.SHORT]
    flat, sizes = own.greedy_all(words)
    assert [p.tolist() for p in np.split(flat, np.cumsum(sizes)[:-1])] == list(map(own.greedy, words))
    assert [np.frombuffer(p, dtype="<u4").tolist() for p in own.merge_all(words)] == list(map(own.merge, words))
    assert [np.frombuffer(p, dtype="<u4").tolist() for p in own.merge_all([b"a"])] == [own.merge(b"a")]


def test_lookup_holds_every_key():
    keys = np.unique(np.random.default_rng(6).integers(0, 1 << 40, 5000)) * 2
    found = bpe.Lookup(keys, np.arange(len(keys)))
    assert found.get(keys, -1).tolist() == list(range(len(keys))) and set(found.get(keys + 1, -1).tolist()) == {-1}


def test_top_k_query_matches_sql(spark):
    assert rows(queries.op8_top_k(spark, SMALL)) == sql("op8_top_k")


def test_top_k_odd_rows(spark):
    nan, inf = math.nan, math.inf
    vectors = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, -1.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 0.0]), (40, [5.0]), (7, []), (60, []), (None, [1.0, 2.0]), (20, [1.0, 2.0])]
    made = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, score string, rank int")
    got = sorted(tuple(r) for r in topk.top_k(made, k=3).collect())
    top = 64 * 64 + 128 * 128
    assert got == [(0, 1, 1, top), (0, 2, 1, top), (0, 3, 20, top), (20, 1, 0, top), (20, 2, 1, top), (20, 3, 1, top), (60, 1, 7, 0)]
    assert topk.top_k(made.limit(0)).count() == 0


def test_trees_against_brute_force():
    rng = np.random.default_rng(4)
    x = np.floor(64 * np.vstack([rng.normal(0, 0.2, (2500, 8)), np.tile(rng.normal(0, 0.2, 8), (1500, 1))])).astype(np.float32)
    ids = rng.permutation(4000)
    tree = topk.build(ids, x)
    for q in [*x[:30], *x[-3:]]:
        scores = (x.astype(int) @ q.astype(int)).tolist()
        want = sorted(((s, -i) for s, i in zip(scores, ids.tolist(), strict=True) if i != 7), reverse=True)[:20]
        assert topk.search(tree, q.astype(float), 7, 20) == [(s, -i) for s, i in want]


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[end:]
    stop = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return rest[:end].translate({c: c + 32 for c in range(65, 91)}), tail[:stop]


def brute_rule(host, path):
    fit = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def brute_mined(baskets):
    """All combinations of tokens, those that the same rows have being one, in the order in which they decide."""
    least = math.ceil(urls.SUPPORT * len(baskets) - 1e-9)
    where = {}
    for k, (t, _) in enumerate(baskets):
        for x in set(t):
            where.setdefault(x, set()).add(k)
    lists = {}
    for x in sorted(where):
        lists.setdefault(frozenset(where[x]), []).append(x)
    lists = {x[0]: x for rows, x in lists.items() if len(rows) >= least}
    seen, with_label = Counter(), Counter()
    for t, v in baskets:
        own = sorted(set(t) & lists.keys())
        for n in range(1, len(own) + 1):
            for c in itertools.combinations(own, n):
                seen[c] += 1
                with_label[c, v] += 1
    found = [(c, v, n) for (c, v), n in with_label.items() if n >= least and n / seen[c] >= urls.CONFIDENCE]
    return sorted((-n / seen[c], -n / len(baskets), len(c), " ".join(c), v, [lists[x] for x in c]) for c, v, n in found)


def test_mining_ends_whatever_the_length_of_urls(spark):
    """Equal paths of many parts, and nested ones, whose combinations would be without number."""
    deep = [([f"p{i:02}" for i in range(30)] + ["top=net"], "block")] * 40 + [(["q", "r"], "allow")] * 30 + [(["q", "top=net"], "allow"), (["r"], "block"), (["r", "s"], "block")] * 10
    nested = [([f"n{i:02}" for i in range(k)], "allow" if k % 3 else "block") for k in range(1, 31) for _ in range(4)]
    for rows in (deep, deep + nested):
        made = spark.createDataFrame([(sorted(t), v) for t, v in rows], "tokens array<string>, label string")
        got = urls.mine(made)
        found = {(tuple(x[0] for x in r.antecedent), r.label): (r.confidence, r.support) for r in got.collect()}
        assert all(len(c) <= urls.MOST_TOKENS for c, _ in found)
        for (c, v), (confidence, support) in found.items():
            has = [w for t, w in rows if set(c) <= set(t)]
            assert abs(confidence - has.count(v) / len(has)) < 1e-9 and abs(support - has.count(v) / len(rows)) < 1e-9
        sets = made.select("tokens").distinct()
        best = {tuple(r.tokens): r.label for r in urls.match(sets, got).collect()}
        if rows is deep:
            mined = brute_mined([([x for x in t if x[0] != "p" or x == "p00"], v) for t, v in rows])
            for t in {tuple(sorted(t)) for t, _ in rows}:
                assert best.get(t) == next((v for *_, v, c in mined if all(set(x) & set(t) for x in c)), None)
    assert urls.mine(made.limit(0)).count() == 0


def test_rules_of_many_tokens_are_found(spark):
    """A label that only 14 tokens together decide, and rows of up to 15 tokens that share no pattern."""
    draw = random.Random(5)
    own = [f"t{i:02}" for i in range(14)]
    whole = [(own, "block")] * 20 + [([t for t in own if t != x], "allow") for x in own] * 5
    mixed = [([t for t in (*own, "u0") if draw.random() < 0.8], draw.choice(["allow", "allow", "block"])) for _ in range(60)]
    for rows in (whole, mixed, whole + mixed):
        mined = brute_mined(rows)
        made = spark.createDataFrame([(sorted(t), v) for t, v in rows], "tokens array<string>, label string")
        others = [own, ["new", *own], *(sorted(draw.sample((*own, "u0"), k)) for k in range(1, 16))]
        sets = made.select("tokens").union(spark.createDataFrame([(t,) for t in others], "tokens array<string>")).distinct()
        wanted = {}
        for r in sets.collect():
            wanted[tuple(r.tokens)] = next(((v, name) for *_, name, v, c in mined if all(set(x) & set(r.tokens) for x in c)), None)
        assert rows is not whole or wanted[tuple(own)] == ("block", " ".join(own))
        for targets in ({}, {"targets": sets}):
            best = {tuple(r.tokens): (r.label, r.mined) for r in urls.match(sets, urls.mine(made, **targets)).collect()}
            assert {t: best.get(t) for t in wanted} == wanted


def test_url_query_against_brute_force(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    made = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", urls.tokens(urls.F.col("url"), urls.host(urls.F.col("url")), urls.path(urls.F.col("url"))).alias("t"))
    tokens = {r.page_id: r.t for r in made.collect()}
    rules = {i: brute_rule(*brute_url(u)) for i, u in pages.items()}
    mined = brute_mined([(tokens[i], r.verdict) for i, r in rules.items() if r])
    got = {r.page_id: r for r in queries.op9_url_filter(spark, SMALL).collect()}
    assert got.keys() == pages.keys()
    for i, u in pages.items():
        host, path = brute_url(u)
        want = rules[i].verdict if rules[i] else next((v for *_, v, c in mined if all(set(x) & set(tokens[i]) for x in c)), "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rules[i] and rules[i].name, want)
    assert any(r is None for r in rules.values())


def test_url_odd_rows(spark):
    odd = [None, "", "no scheme/net/", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://net", "x://net/", "a://b://net/", "http://notnet/", "http://x.org/fr/\nq", "http://ÄB.example.com/de/?a=1&b", "http://h?x://y/"]
    made = spark.createDataFrame([(i, u, "x") for i, u in enumerate(odd)] + [(4, odd[4], None)], "page_id long, url string, host string")
    got = urls.judge(made).collect()
    assert len(got) == len(odd) + 1
    for r in got:
        host, path = brute_url(odd[r.page_id])
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name), odd[r.page_id]
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == rule.verdict)
    assert urls.judge(made.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(made.where("page_id < 4")).collect()} == {"allow"}
