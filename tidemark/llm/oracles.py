"""SQL that the text queries are checked against, where SQL can express them."""

from __future__ import annotations

from tidemark.llm import decontaminate, pii
from tidemark.llm.common import LOWER, UPPER

#: Conversations as lists of turns; what another one begins with goes.
CHAT = """
WITH c AS (
    SELECT conv_id, list(DISTINCT {'turn': turn, 'role': role, 'text': text}) AS l FROM conversations GROUP BY conv_id
), o AS (
    SELECT conv_id, list_sort(l) AS l, list_transform(list_sort(l), lambda t: {'role': t.role, 'text': t.text}) AS k FROM c
), p AS (
    SELECT DISTINCT list_slice(k, 1, i) AS k FROM (SELECT k, unnest(range(1, len(k))) AS i FROM o)
), h AS (
    SELECT min(conv_id) AS conv_id, count(*) AS n_copies, k FROM o GROUP BY k
)
SELECT conv_id, CAST(len(k) AS BIGINT) AS n_turns, n_copies,
       array_to_string(list_transform(k, lambda t: '<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)), '') AS text
FROM h WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = h.k)
"""

#: Whole numbers of either side, their products by component, and each query's 20 best.
TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows of the items as lists of words, joined with those of the documents.
DECONTAMINATE = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents
), b AS (
    SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
    SELECT DISTINCT item_id, list_slice(w, i, i + least({decontaminate.WINDOW}, len(w)) - 1) AS g
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least({decontaminate.WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), places AS (
    SELECT r, n, i, list_slice(w, i, i + n - 1) AS g
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT len(g) AS n FROM win) ON len(w) >= n)
), met AS (
    SELECT r, n, i, item_id FROM places JOIN win USING (g)
), hit AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r
), own AS (
    SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM met GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""

DIGITS = "regexp_replace(x.m, '[^0-9]', '', 'g')"
LUHN = f"""list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i:
    CASE WHEN CAST(substr(reverse({DIGITS}), i, 1) AS INTEGER) * (1 + (i - 1) % 2) > 9
         THEN CAST(substr(reverse({DIGITS}), i, 1) AS INTEGER) * (1 + (i - 1) % 2) - 9
         ELSE CAST(substr(reverse({DIGITS}), i, 1) AS INTEGER) * (1 + (i - 1) % 2) END)) % 10 = 0"""
MOD97 = """list_reduce(list_prepend(0, list_transform(string_split(substr(replace(x.m, ' ', ''), 5) || left(replace(x.m, ' ', ''), 4), ''),
    lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE CAST(c AS INTEGER) END)), lambda n, c: (n * CASE WHEN c >= 10 THEN 100 ELSE 10 END + c) % 97) = 1"""
ALONE = "NOT regexp_matches(x.g, '[A-Za-z0-9]$') AND NOT regexp_matches(x.h, '^[A-Za-z0-9]')"

#: The base kinds' patterns, as the contract of the query has them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

KEEP = {
    "email": "true",
    "ip": "len(list_filter(string_split(x.m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0",
    "card": f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}",
    "phone": f"length({DIGITS}) BETWEEN 8 AND 15",
    "iban": f"{ALONE} AND {MOD97}",
    "ssn": ALONE,
}


def _found(kind: pii.Kind) -> str:
    """The kind's spans as kind:start:end, by place."""
    pieces = f"""list_transform(range(1, len(m_{kind.name}) + 1), lambda i: {{
        'm': m_{kind.name}[i], 'g': g_{kind.name}[i], 'h': g_{kind.name}[i + 1],
        's': CAST(list_sum(list_transform(g_{kind.name}[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m_{kind.name}[1:i - 1], lambda y: length(y))), 0) AS BIGINT)}})"""
    keep = KEEP[kind.name]
    if not kind.base and kind.score < pii.LEAST:  # only context words make up for it
        keep = f"{keep} AND regexp_matches(lower(right(x.g, {pii.REACH})), '{kind.context}')"
    return f"list_transform(list_filter({pieces}, lambda x: {keep}), lambda x: '{kind.name}:' || x.s || ':' || (x.s + length(x.m)))"


PII = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT *, {', '.join(f"regexp_extract_all(text, '{p}') AS m_{k}, string_split_regex(text, '{p}') AS g_{k}" for k, p in ({k.name: k.pattern for k in pii.KINDS} | PATTERNS).items())} FROM t),
s AS (SELECT doc_id, {', '.join(f"{_found(k)} AS s_{k.name}" for k in pii.KINDS)} FROM m)
SELECT doc_id, {', '.join(f"CAST(len(s_{k.name}) AS BIGINT) AS n_{k.name}" for k in pii.KINDS if k.base)},
       sha256(array_to_string({' || '.join(f's_{k.name}' for k in pii.KINDS if k.base)}, ',')) AS base_sha256,
       array_to_string({' || '.join(f's_{k.name}' for k in pii.KINDS)}, ',') AS spans
FROM s
"""

SQL = {"op4_chat_format": CHAT, "op6_pii": PII, "op8_top_k": TOP_K, "op10_decontaminate": DECONTAMINATE}
