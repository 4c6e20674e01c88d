"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Only DataFrame functions. A pattern's matches and the stretches between them come from the same leftmost search, so
their lengths give each match's place in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """What a kind's spans are.

    pattern: as specified. java: has the same matches, and never goes over a run of characters again and again.
    hint: holds of every text that can have a match. keep: holds of a match x.m behind the stretch x.g and before x.h.
    score: before context; context: words that raise it. A kind that isn't base needs a score of LEAST.
    """

    name: str
    pattern: str
    java: str
    hint: str
    keep: str
    score: float
    context: str
    base: bool = True


# The patterns of the base kinds, in the order in which spans are listed.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Characters of an account number by country.
IBAN_SIZES = """
    AD 24 AE 23 AL 28 AT 20 AZ 28 BA 20 BE 16 BG 22 BH 22 BR 29 BY 28 CH 21 CR 22 CY 28 CZ 24 DE 22 DK 18 DO 28 EE 20
    EG 29 ES 24 FI 18 FO 18 FR 27 GB 22 GE 22 GI 23 GL 18 GR 27 GT 28 HR 21 HU 28 IE 22 IL 23 IQ 23 IS 26 IT 27 JO 30
    KW 30 KZ 20 LB 28 LC 32 LI 21 LT 20 LU 20 LV 21 LY 25 MC 27 MD 24 ME 22 MK 19 MR 27 MT 31 MU 30 NL 18 NO 15 PK 24
    PL 28 PS 29 PT 25 QA 29 RO 24 RS 22 SA 24 SC 31 SE 24 SI 19 SK 24 SM 27 ST 25 SV 28 TL 23 TN 24 TR 26 UA 29 VA 22
    VG 24 XK 20
""".split()


def iban() -> str:
    """Of each country as many characters as its numbers have, alone or in groups of four, whatever stands behind them."""
    sizes = dict(zip(IBAN_SIZES[::2], map(int, IBAN_SIZES[1::2]), strict=True))
    parts = []
    for size in sorted(set(sizes.values())):
        of, (fours, rest) = "|".join(c for c, n in sizes.items() if n == size), divmod(size - 4, 4)
        parts.append(rf"({of})[0-9]{{2}}(\x20?[A-Z0-9]{{4}}){{{fours}}}" + rf"\x20?[A-Z0-9]{{{rest}}}" * bool(rest))
    return f"({'|'.join(parts)})"


IBAN = iban()
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"

OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
LUHN = f"""aggregate(transform(split(reverse({DIGITS}), ''), (c, i) -> int(c) * (1 + i % 2)), 0,
    (n, d) -> n + if(d > 9, d - 9, d)) % 10 = 0"""
#: The first four characters go behind the rest, letters count 10 to 35, and the number has to leave 1.
MOD97 = """aggregate(split(concat(substr(replace(x.m, ' ', ''), 5), left(replace(x.m, ' ', ''), 4)), ''), 0,
    (n, c) -> if(c >= 'A', n * 100 + ascii(c) - 55, n * 10 + int(c)) % 97) = 1"""
#: Neither letter nor digit on either side.
ALONE = "NOT rlike(x.g, '[A-Za-z0-9]$') AND NOT rlike(x.h, '^[A-Za-z0-9]')"

KINDS = (
    # A run of the local part's characters is tried from its start only, or from where a match before ended in it.
    Kind("email", EMAIL, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true", 0.9, "mail|contact|write"),
    Kind("ip", IP, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"rlike(text, r'[0-9]\.[0-9]')", rf"rlike(x.m, r'^{OCTET}(\.{OCTET}){{3}}$')", 0.6, "address|host|server"),
    Kind("card", CARD, r"[0-9](?:[\x20-]?[0-9])++", "rlike(text, '[0-9](?:[ -]?[0-9]){15}')", f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}", 0.8, "card|visa|credit|payment"),
    Kind("phone", PHONE, PHONE, "contains(text, '+')", f"length({DIGITS}) BETWEEN 8 AND 15", 0.6, "phone|call|mobile"),
    Kind("iban", IBAN, IBAN, "rlike(text, '[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}')", f"{ALONE} AND {MOD97}", 0.9, "iban|account|bank", base=False),
    Kind("ssn", SSN, SSN, "rlike(text, '[0-9]-[0-9]{2}-[0-9]')", ALONE, 0.3, "ssn|social security", base=False),
)

#: A span of a kind that isn't base needs LEAST; context words within REACH code points before a span add BOOST.
LEAST, BOOST, REACH = 0.5, 0.4, 40

#: Matches of a block.
BLOCK = 256

NONE = "cast(array() AS array<struct<kind: string, start: int, end: int, score: double>>)"
PIECES = "cast(array() AS array<struct<m: string, g: string, h: string, start: int>>)"


def _block(m: str, b: str) -> str:
    """SQL for the places, from 0, of the matches of a block."""
    return f"sequence({b} * {BLOCK}, least(size({m}), ({b} + 1) * {BLOCK}) - 1)"


def _offsets(kind: Kind) -> str:
    """SQL for where each block of the kind's matches begins in the text."""
    m, g = f"m_{kind.name}", f"g_{kind.name}"
    size = f"aggregate({_block(m, 'b')}, 0, (n, i) -> n + length({g}[i]) + length({m}[i]))"
    none = "cast(array() AS array<int>)"
    blocks = f"sequence(0, (size({m}) - 1) div {BLOCK})"
    return f"if(size({m}) = 0, {none}, slice(aggregate(transform({blocks}, x -> int(x)), array(0), (o, b) -> concat(o, array(element_at(o, -1) + {size}))), 1, int((size({m}) - 1) div {BLOCK}) + 1))"


def _spans(kind: Kind) -> str:
    """SQL for the kind's spans, from its matches m_kind, the stretches g_kind between them and where blocks begin."""
    m, g, o = f"m_{kind.name}", f"g_{kind.name}", f"o_{kind.name}"
    # Lists are only ever added to within a block of matches, so that many matches take no square of steps.
    pieces = f"""flatten(transform({o}, (at, b) -> aggregate({_block(m, 'b')}, named_struct('at', at, 'out', {PIECES}), (a, i) -> named_struct(
        'at', a.at + length({g}[i]) + length({m}[i]),
        'out', concat(a.out, array(named_struct('m', {m}[i], 'g', {g}[i], 'h', {g}[i + 1], 'start', a.at + length({g}[i])))))
        , a -> a.out)))"""
    score = f"least(1D, {kind.score}D + if(rlike(lower(right(x.g, {REACH})), '{kind.context}'), {BOOST}D, 0D))"
    spans = f"transform(filter({pieces}, x -> {kind.keep}), x -> named_struct('kind', '{kind.name}', 'start', x.start, 'end', x.start + length(x.m), 'score', {score}))"
    if not kind.base:
        spans = f"filter({spans}, x -> x.score >= {LEAST}D)"
    return f"if(size({o}) = 0, {NONE}, {spans})"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns to keep, spans (array of kind, start, end, score; by kind as listed, then by start), a row for each row.

    Places are code points, end exclusive. A match that its checksum or length refutes goes, without another try in it.
    Null texts count as empty and have no spans; repeated rows stay repeated; spans of different kinds may overlap;
    no rows give no rows. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep)
    empty = "cast(array() AS array<string>)"
    rows = rows.selectExpr("*", *(f"if({k.hint}, regexp_extract_all(text, r'{k.java}', 0), {empty}) AS m_{k.name}" for k in kinds))
    rows = rows.selectExpr("*", *(f"if(size(m_{k.name}) > 0, split(text, r'{k.java}', -1), {empty}) AS g_{k.name}" for k in kinds))
    rows = rows.selectExpr("*", *(f"{_offsets(k)} AS o_{k.name}" for k in kinds))
    return rows.selectExpr("doc_id", "text", *keep, f"concat({', '.join(map(_spans, kinds))}) AS spans")


def listed(spans: Column | str) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted() -> Column:
    """Of find()'s rows, text with each run of overlapping spans replaced by the first one's kind, as in <EMAIL>."""
    runs = """aggregate(array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))),
        cast(array() AS array<struct<start: int, end: int, kind: string>>),
        (done, s) -> if(size(done) > 0 AND s.start < element_at(done, -1).end,
            concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start,
                'end', greatest(element_at(done, -1).end, s.end), 'kind', element_at(done, -1).kind))),
            concat(done, array(s))))"""
    pieces = f"""aggregate({runs}, named_struct('at', 0, 'out', cast(array() AS array<string>)),
        (a, s) -> named_struct('at', s.end, 'out', concat(a.out, array(substring(text, a.at + 1, s.start - a.at), concat('<', upper(s.kind), '>')))),
        a -> array_join(concat(a.out, array(substring(text, a.at + 1))), ''))"""
    return F.expr(f"if(size(spans) = 0, text, {pieces})")
