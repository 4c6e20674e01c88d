"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items, one scan of every whole text.

The automaton's alphabet numbers the items' words, two characters a word, so that a window of ten words takes twenty
nodes however long the words are, and no node has very many children. A word that no item has leads to the root.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from math import isqrt

import ahocorasick
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_BYTES, map_rows, utf8, words

WINDOW = 10

#: Windows of one automaton, at most: some 500 MB in a worker. A benchmark of more is scanned for in several passes.
MAX_WINDOWS = 500_000

SCHEMA = """doc_id long, n_words long, n_hit long, items array<long>,
            hits array<struct<first_word: long, end_word: long, start: long, end: long>>"""

#: Ids and texts of items.
Items = list[tuple[int, bytes]]


class _Code(dict):
    """Word -> its two characters; any other word has two that no window has."""

    def __missing__(self, word: bytes) -> str:
        return "\0\0"


class Index:
    """The automaton, with each window's number of words and the items that have it."""

    def __init__(self, items: Iterable[tuple[int, bytes]], width: int = WINDOW) -> None:
        split = [(item, words(text)) for item, text in items]
        known = {w: k for k, w in enumerate(dict.fromkeys(w for _, own in split for w in own))}
        base = isqrt(len(known)) + 1
        # The first character of a word is of one alphabet, the second of another: no match begins within a word.
        self.code = _Code((w, chr(0x10000 + k // base) + chr(0x80000 + k % base)) for w, k in known.items())
        self.size: list[int] = []
        self.items: list[list[int]] = []
        at: dict[str, int] = {}
        for item, own in split:
            n = min(width, len(own))
            text = "".join(map(self.code.__getitem__, own))
            for i in range(len(own) - n + 1 if own else 0):
                k = at.setdefault(text[2 * i : 2 * (i + n)], len(at))
                if k == len(self.size):
                    self.size.append(n)
                    self.items.append([])
                if item not in self.items[k][-1:]:
                    self.items[k].append(item)
        self.automaton = ahocorasick.Automaton()
        for window, k in at.items():
            self.automaton.add_word(window, k)
        self.automaton.make_automaton()


def scan(text: bytes, index: Index) -> tuple[int, int, list[int], list[tuple[int, int, int, int]]]:
    """Words, words hit, items, and maximal runs of hit words with their code points in the text."""
    tokens = text.translate(WORD_BYTES).split()
    if not index.size or not tokens:
        return len(tokens), 0, [], []
    # Where the last word of a window ends, and the window.
    met = [(end // 2 + 1, k) for end, k in index.automaton.iter("".join(map(index.code.__getitem__, tokens)))]
    if not met:
        return len(tokens), 0, [], []
    runs: list[list[int]] = []
    for end, k in met:
        first = end - index.size[k]
        while runs and first <= runs[-1][1]:
            first = min(first, runs.pop()[0])
        runs.append([first, end])
    found = sorted({item for k in {k for _, k in met} for item in index.items[k]})
    return len(tokens), sum(b - a for a, b in runs), found, [(a, b, *span) for (a, b), span in zip(runs, _spans(text, tokens, runs), strict=True)]


def _spans(text: bytes, tokens: list[bytes], runs: list[list[int]]) -> list[tuple[int, int]]:
    """Code points of the runs in the original text; normalising kept each byte's place."""
    flat, at, word, out, chars, done = text.translate(WORD_BYTES), 0, 0, [], 0, 0
    for first, end in runs:
        span = []
        for want in (first, end - 1):
            while word <= want:
                at = flat.index(tokens[word], at)
                start, at, word = at, at + len(tokens[word]), word + 1
            span.append((start, at))
        a, b = span[0][0], span[1][1]
        chars += len(text[done:a].decode())
        size = len(text[a:b].decode())
        out.append((chars, chars + size))
        chars, done = chars + size, b
    return out


#: By the broadcast value's id and the width; the value is kept with the index, so that no other one gets that id.
_built: dict[tuple[int, int], tuple[Items, Index]] = {}


def _index(sent: Broadcast, width: int) -> Index:
    """Built once in a worker."""
    key = id(sent.value), width
    if key not in _built:
        _built.clear()
        _built[key] = (sent.value, Index(sent.value, width))
    return _built[key][1]


#: Runs of several passes, sorted by their first word, made maximal.
MERGED = """aggregate(hits, slice(hits, 1, 0), (done, h) ->
    if(size(done) > 0 and element_at(done, -1).end_word >= h.first_word,
       concat(slice(done, 1, size(done) - 1), array(named_struct(
           'first_word', element_at(done, -1).first_word, 'end_word', greatest(element_at(done, -1).end_word, h.end_word),
           'start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, h.end)))),
       concat(done, array(h))))"""


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids, sorted), hits (runs of hit words as words and as code points), a row a row.

    The items' texts are broadcast, and workers make the automaton of them. The bound of what is broadcast is
    max_windows, or one item where that has more: a larger benchmark is taken in passes, of which the driver holds one
    at a time, each of them a scan of the texts, put together by row. Null texts have no words; items without words or
    id match nothing; repeated items count once, repeated documents stay repeated. A very long text is scanned as a
    whole, and its hits are a row's. No items: no hits. Other columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    wanted = items.where(F.col(item_id_col).isNotNull()).select(F.col(item_id_col).cast("long").alias("item"), utf8(F.col(item_text_col)).alias("text"))
    passes, own, windows = [], [], 0
    for item, text in wanted.distinct().toLocalIterator():
        n = len(words(bytes(text)))
        more = max(1, n - width + 1) if n else 0
        if own and windows + more > max_windows:
            passes.append(spark.sparkContext.broadcast(own))
            own, windows = [], 0
        if more:
            own.append((item, bytes(text)))
            windows += more
    passes.append(spark.sparkContext.broadcast(own))

    # Rows of several passes are put together by id and text; equal rows have equal results, so their number is enough.
    rows = rows.select("doc_id", (F.sha2("text", 256) if len(passes) > 1 else F.lit("")).alias("key"), "text")

    def one(sent: Broadcast) -> DataFrame:
        def make() -> Callable[..., tuple]:
            made = _index(sent, width)

            def row(i: int, key: str, text: bytes) -> tuple:
                n, hit, own, hits = scan(text, made)
                return i, key, n, hit, own, [dict(zip(("first_word", "end_word", "start", "end"), x, strict=True)) for x in hits]

            return row

        return map_rows(rows, make, SCHEMA.replace("n_words", "key string, n_words", 1))

    if len(passes) == 1:
        return one(passes[0]).drop("key")
    several = reduce(DataFrame.unionByName, map(one, passes)).groupBy("doc_id", "key")
    several = several.agg(
        F.count("*").alias("copies"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_set("hits"))).alias("hits"),
    ).withColumn("hits", F.expr(MERGED))
    several = several.withColumn("n_hit", F.expr("aggregate(hits, 0L, (n, h) -> n + h.end_word - h.first_word)"))
    several = several.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("copies") / len(passes)).cast("int"))))
    return several.select("doc_id", "n_words", "n_hit", "items", "hits")
