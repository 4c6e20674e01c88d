from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from tidemark.llm import pii, queries

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, spans string, m_email string"


#: As the query's contract has them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def brute(text: str | None) -> list[str]:
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m)
    for kind in pii.KINDS:
        last = 0
        for x in re.finditer(BASE.get(kind.name, kind.pattern), text):
            m, g, h = x.group(), text[last : x.start()], text[x.end() :]
            last = x.end()
            near = re.search(kind.context, g[-pii.REACH :].lower()) is not None
            alone = not re.search("[A-Za-z0-9]$", g) and not re.match("[A-Za-z0-9]", h)
            ok = {
                "email": True,
                "ip": kind.name == "ip" and all(int(p) <= 255 for p in m.split(".")),
                "card": 16 <= len(digits(m)) <= 19 and luhn(digits(m)),
                "phone": 8 <= len(digits(m)) <= 15,
                "iban": kind.name == "iban" and alone and mod97(m),
                "ssn": alone and near,
            }[kind.name]
            if ok:
                out.append(f"{kind.name}:{x.start()}:{x.end()}")
    return out


ODD = [
    None, "", "a@b", "a@b.c_d@e.f", "x.y+z@a-b.co.uk.", "..@..", "a@b.c@d.e f%g@h.i", "é@é.com ü😀 me@x.org 😀",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.01 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111111111",
    "4111 1111  1111 1111", "+1 (988) 555-2485 +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 +4 4", "++12345678+12345678)",
    "IBAN GB82 WEST 1234 5698 7654 32 or DE89370400440532013000, XGB82WEST12345698765432", "DE89370400440532013001",
    "SSN 123-45-6789; 123-45-6789", "9" * 30_000 + " " + "a" * 30_000 + "@" + " 1-" * 20_000, "@" * 1000 + "+" * 1000,
]


def test_odd_texts(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(0, None, None, None), (None, "a@b.c", None, None)]
    got = pii.find(spark.createDataFrame(rows, DOCS)).select("doc_id", pii.listed("spans").alias("s")).collect()
    assert sorted(got, key=str) == sorted([(i, ",".join(brute(t))) for i, t, *_ in rows], key=str)
    assert any("iban" in r.s for r in got) and any("ssn" in r.s for r in got)
    assert pii.find(spark.createDataFrame([], DOCS)).count() == 0


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op6_pii(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        spans = brute(t)
        assert got[i].spans == ",".join(spans)
        base = [s for s in spans if s.split(":")[0] in ("email", "ip", "card", "phone")]
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert got[i].n_email == sum(s.startswith("email:") for s in spans)
    assert sum(r.n_card + r.n_ip + r.n_phone + r.n_email for r in got.values()) > 3


def test_account_numbers_end_where_their_country_says(spark):
    number = "ES91 2100 0418 4502 0005 1332"
    texts = [f"pay {number} AND go", f"{number}, or", f"x {number.replace(' ', '')} 2020", "GB82 WEST 1234 5698 7654 32 OK", f"{number}2", "ZZ91 2100 0418 4502 0005 1332", "NO93 8601 1117 947 A1"]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r.s for r in found.select("doc_id", pii.listed(F.filter("spans", lambda x: x["kind"] == "iban")).alias("s")).collect()}
    assert got == {0: "iban:4:33", 1: "iban:0:29", 2: "iban:2:26", 3: "iban:0:27", 4: "", 5: "", 6: "iban:0:18"}


def test_very_many_spans(spark):
    text = " ".join(f"u{i}@h{i % 7}.org, 10.0.{i % 256}.{i % 99}" for i in range(30_000))
    got = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pii.listed("spans").alias("s")).first().s
    assert got == ",".join(brute(text)) and got.count(",") == 59_999


def test_redaction(spark):
    rows = [(1, "write a@b.c or 😀 1.2.3.4!"), (2, None), (3, "no"), (4, "+ 4111 1111 1111 1111"), (5, "a@b.c")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.t for r in found.select("doc_id", pii.redacted().alias("t")).collect()}
    assert got == {1: "write <EMAIL> or 😀 <IP>!", 2: "", 3: "no", 4: "+ <CARD>", 5: "<EMAIL>"}


def test_context_raises_the_score(spark):
    found = pii.find(spark.createDataFrame([(1, "1.2.3.4"), (2, "server 1.2.3.4")], "doc_id long, text string"))
    assert {r.doc_id: r.s for r in found.select("doc_id", F.col("spans")[0]["score"].alias("s")).collect()} == {1: 0.6, 2: 1.0}
