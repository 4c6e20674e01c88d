"""License notices by fuzzy search: exact seeds locate candidates, bounded-error matching verifies them.

A notice that may have k errors is cut into k + 1 pieces; whatever matches it with at most k errors holds a piece
unchanged. Texts without any piece, nearly all, are never matched with errors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, utf8, words


@dataclass(frozen=True)
class Notice:
    """Lower-case words, spaced. errors: edits of a character that a match may have. base: its exact places count."""

    label: str
    phrase: str
    errors: int
    base: bool = False


#: The base phrases, then further short notices.
NOTICES = (
    Notice("gpl", "gnu general public license", 2, base=True),
    Notice("apache", "apache license", 1, base=True),
    Notice("cc-by", "cc by", 0, base=True),
    Notice("mit", "mit license", 1, base=True),
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("agpl", "gnu affero general public license", 2),
    Notice("mpl", "mozilla public license", 2),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("cc-by-nc", "cc by nc", 0),
    Notice("cc-by-sa", "cc by sa", 0),
    Notice("cc0", "cc0 1 0 universal", 1),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("isc", "permission to use copy modify and or distribute this software", 5),
    Notice("unlicense", "free and unencumbered software released into the public domain", 5),
)

SCHEMA = """doc_id long, n_words long,
            spans array<struct<label: string, base: boolean, first_word: long, end_word: long, errors: int, score: double>>"""


@dataclass(frozen=True)
class Search:
    notice: Notice
    seeds: tuple[tuple[int, bytes], ...]
    pattern: regex.Pattern


def search(notice: Notice) -> Search:
    raw, n = notice.phrase.encode(), notice.errors + 1
    cuts = [len(raw) * i // n for i in range(n + 1)]
    seeds = tuple((a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
    # Whole words only; of the ways to match at a place, one with few errors.
    return Search(notice, seeds, regex.compile(f"(?e)(?<= )(?:{regex.escape(notice.phrase, literal_spaces=True)}){{e<={notice.errors}}}(?= )".encode()))


def _all(text: bytes, part: bytes, start: int, end: int) -> list[int]:
    out, at = [], text.find(part, start, end)
    while at >= 0:
        out.append(at)
        at = text.find(part, at + 1, end)
    return out


def places(text: bytes, found: Search) -> list[tuple[int, int, int]]:
    """(start, end, errors) in words spaced and with a space at either end: all exact places, and fuzzy ones between."""
    notice = found.notice
    size, slack = len(notice.phrase), notice.errors
    regions: list[list[int]] = []
    for at in sorted(hit - offset for offset, seed in found.seeds for hit in _all(text, seed, 0, len(text))):
        a, b = max(0, at - slack - 1), min(len(text), at + size + 2 * slack + 1)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], b)
        else:
            regions.append([a, b])
    out = []
    whole = f" {notice.phrase} ".encode()
    for a, b in regions:
        at = a
        for x in [*_all(text, whole, a, b), None]:
            if slack:
                out += [(m.start(), m.end(), sum(m.fuzzy_counts)) for m in found.pattern.finditer(text, at, b if x is None else x + 1)]
            if x is not None:
                out.append((x + 1, x + 1 + size, 0))
                at = x + size
    return out


def scan(text: bytes, searches: list[Search]) -> tuple[int, list[tuple]]:
    tokens = words(text)
    joined = b" " + b" ".join(tokens) + b" "
    spans = []
    for s in searches:
        if any(seed in joined for _, seed in s.seeds):
            for a, b, errors in places(joined, s):
                first = joined.count(b" ", 0, a) - 1
                score = 1 - errors / len(s.notice.phrase)
                spans.append((s.notice.label, s.notice.base and not errors, first, first + joined.count(b" ", a, b) + 1, errors, score))
    return len(tokens), sorted(spans, key=lambda x: x[2:])


def notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, spans (label, whether an exact place of a base phrase, words from and up to, errors, score).

    A row for each row. Errors are of UTF-8 bytes; a fuzzy span is of whole words. Null and empty texts have no words
    and no spans; repeated rows stay repeated; no rows give no rows. Other columns aren't read.
    """

    def make() -> Callable[..., tuple]:
        searches = [search(n) for n in wanted]
        names = ("label", "base", "first_word", "end_word", "errors", "score")

        def row(i: int, text: bytes) -> tuple:
            n, spans = scan(text, searches)
            return i, n, [dict(zip(names, s, strict=True)) for s in spans]

        return row

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col))), make, SCHEMA)
