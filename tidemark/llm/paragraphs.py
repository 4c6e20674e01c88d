"""Repeated passages by MinHash banding of paragraphs.

Texts and paragraphs (lines) with equal words are one. The others' MinHash bands propose pairs, exact Jaccard similarity
of word shingles verifies them, and of each connected component all but the first occurrence go.

A passage may also stand within longer lines. There every run of EVERY windows of words is a paragraph, with one band of
one row: the window of least hash, its mark. Neighbouring runs mostly have the same mark, so that a text has few of
them. Texts that share a mark are laid on one another there, and the stretch around it whose shingles are similar goes
where it's long enough. The one it's compared with is the mark's first occurrence, so each component keeps its first.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_BYTES, cut, map_rows, release, remove, small_batches, utf8, words, written
from tidemark.llm.components import components

#: Words of a shingle, least similarity, words that a text or line needs to count.
WIDTH, SIMILARITY, LEAST_WORDS = 5, 0.8, 5

#: Words of a window, and windows in a row of which the one with the least hash is a mark: equal runs of 25 words have
#: one, so that of 51 words with one changed one half has.
WINDOW, EVERY = 10, 16

#: Words that a stretch needs to count: the shortest run that can't do without a mark.
LEAST_PASSAGE = WINDOW + EVERY - 1

#: Words of a block of a text that is laid on another, and words on either side that it's seen with.
BLOCK, AROUND = 256, 48

#: Unequal words between two equal runs of a stretch, at most; the similarity of the whole decides.
GAP = 10

#: A place is a text's rank and a word of it: 2^32 texts, as long as a string can be.
WORD, CELL = 31, BLOCK.bit_length() - 1

#: Of a mark's hash; two that are alike by chance only make texts be compared that needn't be.
MARK = np.uint64((1 << 40) - 1)

#: At a similarity of 0.8 a pair shares one of these bands with a probability of 0.994, at 0.9 of 0.9998.
BANDS, ROWS = 5, 2

#: Numbers that are broadcast, some 50 MB at most; more of them are joined by a shuffle.
MOST_NUMBERS = 4_000_000

#: Members of a block of a bucket, on average, and their bytes.
MEMBERS, MEMBER_BYTES = 128, 2_000_000

_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.Generator(np.random.PCG64(20240229))
_FACTOR = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


#: Per byte of a word, letters in lower case: a random factor.
_LETTER = _rng.integers(0, 2**63, 256, dtype=np.uint64)


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes from and up to of each word, and its hash: the sum of one for each letter and place."""
    flat = np.frombuffer(text.translate(WORD_BYTES), dtype=np.uint8)
    inside = flat != 0x20
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return starts, ends, np.empty(0, dtype=np.uint64)
    first = np.zeros(len(flat), dtype=np.int64)
    first[starts] = starts
    place = (np.arange(len(flat)) - np.maximum.accumulate(first)).astype(np.uint64)
    return starts, ends, np.add.reduceat(np.where(inside, _mixed((_LETTER[flat] ^ place * _MIX) * _SPREAD), np.uint64(0)), starts)


def grams(own: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of hashed words; fewer words than a window's have none."""
    n = len(own) - width + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = out * _MIX + own[i : i + n]
    return _mixed(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def marks(hashes: np.ndarray, every: int = EVERY) -> np.ndarray:
    """Of all runs of so many windows the first one with the least hash."""
    if len(hashes) < every:
        return np.empty(0, dtype=np.int64)
    least = np.lib.stride_tricks.sliding_window_view(hashes, every).argmin(axis=1)
    return np.unique(least + np.arange(len(least)))


def bands(own: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each line (words from and up to) its bands: hashes of the least hashes of its shingles. Fewer words than a
    shingle's are one."""
    out = np.zeros((len(first), BANDS), dtype=np.uint64)
    short = end - first < WIDTH
    long = np.flatnonzero(~short)
    if len(long):
        # Each permutation's least values by line; the cell behind the last shingle only keeps the ends in range.
        all_ = np.append(grams(own, WIDTH), np.uint64(2**64 - 1))
        cuts = np.stack([first[long], end[long] - WIDTH + 1], axis=1).ravel()
        least = np.stack([np.minimum.reduceat(all_ * _FACTOR[k] + _ADD[k], cuts)[::2] for k in range(BANDS * ROWS)])
        value = np.zeros((BANDS, len(long)), dtype=np.uint64)
        for r in range(ROWS):
            value = value * _MIX + least[r::ROWS]
        out[long] = _mixed(value).T
    for i in np.flatnonzero(short):
        out[i] = _mixed(grams(own[first[i] : end[i]], int(end[i] - first[i])) * _FACTOR[:BANDS])
    return out.view(np.int64)


def points(text: bytes, places: np.ndarray) -> np.ndarray:
    """Code points of places that are bytes."""
    if text.isascii():
        return places
    return np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])[places]


def lines(text: bytes, starts: np.ndarray, least_words: int) -> tuple[np.ndarray, ...]:
    """Bytes from and up to, and words from and up to, of each line that has enough words; starts: of the words."""
    ends = np.append(np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 0x0A), len(text))
    begins = np.append(0, ends[:-1] + 1)
    first, end = np.searchsorted(starts, begins), np.searchsorted(starts, ends)
    keep = end - first >= max(1, least_words)
    return begins[keep], ends[keep], first[keep], end[keep]


def keys(own: np.ndarray) -> tuple[int, int]:
    """Two hashes of 64 bits of a line's hashed words."""
    return struct.unpack(">qq", xxhash.xxh3_128_digest(own.tobytes()))


def similar(a: set, b: set, similarity: float) -> bool:
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both)


def shingles(tokens: list, width: int = WIDTH) -> Iterator[tuple]:
    width = min(width, len(tokens))
    return zip(*(tokens[i:] for i in range(width)), strict=False)


def links(members: list[tuple[int, int, int, bytes]], first: int, second: int, similarity: float) -> list[tuple[int, int]]:
    """Links (a, b) between labels that join what is similar among members (key, label, block, words): those of one block
    with one another if first is second, else those of the first with those of the second. What's joined isn't compared."""
    sets = [(label, block, set(shingles(w.split(b" ")))) for _, label, block, w in sorted(members)]
    head: dict[int, int] = {}

    def find(i: int) -> int:
        while (j := head.get(i, i)) != i:
            head[i] = head.get(j, j)
            i = j
        return i

    out = []
    left, right = ([i for i, x in enumerate(sets) if x[1] == block] for block in (first, second))
    for i in left:
        a, _, x = sets[i]
        for j in right:
            b, _, y = sets[j]
            if (first == second and j <= i) or min(len(x), len(y)) < similarity * max(len(x), len(y)) or find(a) == find(b):
                continue
            if similar(x, y, similarity):
                head[find(b)] = find(a)
                out.append((a, b))
    return out


def alike(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, least: int, similarity: float = SIMILARITY) -> list[tuple[int, int, int]]:
    """Anchors (i, j), places in hashed words x and y -> (from, up to, from in y) of the stretches of x around them.

    A stretch runs along one diagonal: it begins with the run of equal words that an anchor is in, takes in the nearest
    further runs of a shingle's words or more while the shingles of both sides, place by place, are similar, and has
    least words. At last its sides' sets of shingles are compared.
    """
    out, near = [], None
    for shift in np.unique(j - i).tolist():
        low, high = max(0, -shift), min(len(x), len(y) - shift)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], x[low:high] == y[low + shift : high + shift], [False]]).astype(np.int8))) + low
        edges = edges.reshape(-1, 2)
        runs = edges[edges[:, 1] - edges[:, 0] >= WIDTH].tolist()
        done = -1
        for at in np.searchsorted([s for s, _ in runs], np.sort(i[j - i == shift]), side="right").tolist():
            first = last = at - 1
            if first <= done:
                continue
            (s, e), both = runs[first], runs[first][1] - runs[first][0] - WIDTH + 1
            while True:
                # The nearer side first; equal shingles and all of either side.
                wider = []
                if first and s - runs[first - 1][1] <= GAP:
                    wider.append((s - runs[first - 1][1], first - 1, last, first - 1))
                if last + 1 < len(runs) and runs[last + 1][0] - e <= GAP:
                    wider.append((runs[last + 1][0] - e, first, last + 1, last + 1))
                for _, f, n, new in sorted(wider):
                    more = both + runs[new][1] - runs[new][0] - WIDTH + 1
                    if more >= similarity * (2 * (runs[n][1] - runs[f][0] - WIDTH + 1) - more):
                        first, last, both, s, e = f, n, more, runs[f][0], runs[n][1]
                        break
                else:
                    break
            if first < last and e - s >= least:
                # Equal shingles are equal place by place or more; where they don't repeat much, that's enough.
                if near is None:
                    near = grams(x.view(np.uint32).astype(np.uint64), WIDTH)
                equal = {g for f, n in runs[first : last + 1] for g in near[f : n - WIDTH + 1].tolist()}
                if len(equal) < similarity * (len(equal) + 2 * (e - s - WIDTH + 1 - both)):
                    sides = (set(shingles(side)) for side in (x[s:e].tolist(), y[s + shift : e + shift].tolist()))
                    if not similar(*sides, similarity):
                        first = last = at - 1
                        s, e = runs[first]
            done = last
            if e - s >= least:
                out.append((s, e, s + shift))
    return out


def merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches (from, up to, kept) that overlap or adjoin as one, which has the first one's kept place."""
    out: list[list[int]] = []
    for s, e, kept in sorted(found):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, kept])
    return [(s, e, kept) for s, e, kept in out]


def _dealt(df: DataFrame, col: str) -> DataFrame:
    """A second key: a join by both deals out both sides anew, and the adaptive planner can split a hot key."""
    return df.withColumn("h", F.pmod(F.xxhash64(col), F.lit(4)).cast("byte"))


def _join(a: DataFrame, b: DataFrame, col: str, how: str = "inner") -> DataFrame:
    return _dealt(a, col).join(_dealt(b, col), [col, "h"], how).drop("h")


LINE = ("start", "end", "n_words", "key", "key2", "bands")


def _read(rows: DataFrame, least_words: int) -> tuple[DataFrame, str]:
    """doc_id, same and whole (its text's hashes, of 64 and 128 bits), size (its words), chars, marks and their keys, and
    of its lines the places, two hashes of 64 bits and bands; n numbers the rows. Texts are read once; this is kept."""

    def make() -> Callable[..., tuple]:
        def row(i: int, text: bytes, same: int, whole: bytes) -> tuple:
            starts, _, own = hashed(text)
            hashes = grams(own, WINDOW)
            at = marks(hashes)
            begins, ends, first, end = lines(text, starts, least_words)
            places = points(text, np.concatenate([begins, ends, [len(text)]]))
            both = np.array([keys(own[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)], dtype=np.int64).reshape(-1, 2)
            line = (places[: len(begins)], places[len(begins) : -1], end - first, both[:, 0], both[:, 1], list(bands(own, first, end)))
            return i, same, whole, len(own), int(places[-1]), at, (hashes[at] & MARK).view(np.int64), *line

        return row

    kinds = ("int", "int", "int", "long", "long", "array<long>")
    schema = "doc_id long, same long, whole binary, size int, chars int, marks array<int>, keys array<long>, "
    schema += ", ".join(f"{name} array<{kind}>" for name, kind in zip(LINE, kinds, strict=True))
    found = map_rows(rows.select("doc_id", "text", F.xxhash64("text"), F.unhex(F.md5("text"))), make, schema)
    return written(found.withColumn("n", F.monotonically_increasing_id()), "passages")


def _met(rows: DataFrame, wanted: DataFrame, *cols: str) -> DataFrame:
    """text and cols of wanted, at the rows with wanted's doc_id and same."""
    wanted = cut(wanted.select(F.col("doc_id").alias("own"), F.col("same").alias("its"), *cols))
    lists = [F.size(c) for c, kind in wanted.dtypes if kind.startswith("array")]
    if (wanted.agg(F.sum(sum(lists, F.lit(8)))).first()[0] or 0) <= MOST_NUMBERS:
        wanted = F.broadcast(wanted)
    same = F.xxhash64("text")
    return rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("own")) & (same == F.col("its"))).select("text", *cols)


# Whole texts.


def _copies(read: DataFrame, least_words: int) -> DataFrame:
    rows = read.where(F.col("size") >= max(1, least_words)).select("doc_id", "n", "whole", "chars", "size")
    heads = rows.groupBy("whole").agg(F.min(F.struct("doc_id", "n")).alias("kept"), F.count("*").alias("copies")).where("copies > 1")
    gone = _join(rows, heads, "whole").where("n != kept.n")
    return gone.select("doc_id", F.lit(0).alias("start"), F.col("chars").alias("end"), F.col("size").alias("n_words"), F.col("kept.doc_id").alias("kept_doc_id"), F.lit(0).alias("kept_start"), F.lit("text").alias("unit"))


# Lines.


def _words(rows: DataFrame, wanted: DataFrame, least_words: int) -> DataFrame:
    """key -> its words, read again at its first occurrence (doc_id, same, pos) only."""
    places = wanted.groupBy("doc_id", "same").agg(F.collect_set("pos").alias("places"))

    def make() -> Callable[..., tuple]:
        def row(text: bytes, places: list[int]) -> tuple:
            starts, _, own = hashed(text)
            begins, ends, first, end = lines(text, starts, least_words)
            return ([{"key": keys(own[first[p] : end[p]])[0], "words": b" ".join(words(text[begins[p] : ends[p]]))} for p in places if p < len(first)],)

        return row

    found = map_rows(_met(rows, places, "places"), make, "found array<struct<key: long, words: binary>>").select(F.explode("found").alias("x")).select("x.key", "x.words")
    # Rows of one doc_id and text give the same.
    return cut(found.groupBy("key").agg(F.min("words").alias("words")))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (key, pivot) those that are similar."""

    def make() -> Callable[..., tuple]:
        def row(a: int, b: int, x: bytes, y: bytes) -> tuple:
            return a, b, similar(set(shingles(x.split(b" "))), set(shingles(y.split(b" "))), similarity)

        return row

    both = _join(_join(pairs, texts, "key"), texts.select(F.col("key").alias("pivot"), F.col("words").alias("others")), "pivot")
    return map_rows(both.select("key", "pivot", "words", "others"), make, "a long, b long, ok boolean").where("ok").select("a", "b")


def _classes(first: DataFrame, rows: DataFrame, similarity: float, least_words: int) -> DataFrame:
    """Distinct lines (key, doc_id, same, pos, bands) -> key, component, where a component has several.

    Every member of a bucket is first compared with two of it, which joins most of a large group of near copies. Then
    members of different labels are compared in blocks: a task has the members of two blocks, however large the
    bucket is, makes no row for a pair, and returns fewer links than it has members.
    """
    banded = first.select("key", F.posexplode("bands").alias("band", "value")).select("key", F.xxhash64("band", "value").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("many"), F.bit_xor("key").alias("mix"))
    # Pairs mostly share several buckets: of buckets with equal members one is enough.
    shared = shared.where("low != high").groupBy("low", "high", "many", "mix").agg(F.min("bucket").alias("bucket")).drop("mix")
    met = cut(_join(banded, shared, "bucket"))
    release(rows.sparkSession)
    texts = _words(rows, first.join(met.select("key").distinct(), "key"), least_words)
    pairs = met.select("key", F.explode(F.array("low", "high")).alias("pivot")).where("key != pivot").distinct()
    labels = cut(components(_verified(pairs, texts, similarity)).withColumnsRenamed({"node": "key", "component": "label"}))

    release(rows.sparkSession)
    labelled = _join(met.where("many > 2").select("bucket", "key"), labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    size = F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum(F.length("words")) / MEMBER_BYTES)).cast("int")
    labelled = cut(_join(labelled, texts, "key"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), size.alias("blocks")).where("low != high").select("bucket", "blocks")
    members = _join(labelled, mixed, "bucket")
    members = members.withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    blocks = members.groupBy("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    blocks = blocks.agg(F.collect_list(F.struct("key", "label", "block", "words")).alias("members")).where("size(members) > 1")

    def make() -> Callable[..., tuple]:
        def row(i: int, j: int, own: list[dict]) -> tuple:
            found = links([(m["key"], m["label"], m["block"], m["words"]) for m in own], i, j, similarity)
            return ([dict(zip("ab", x, strict=True)) for x in found],)

        return row

    found = map_rows(blocks.select("i", "j", "members"), make, "links array<struct<a: long, b: long>>").select(F.explode("links").alias("x")).select("x.*")
    second = components(found).withColumnsRenamed({"node": "label"})
    ends = labels.join(second, "label", "full").select(F.col("key"), "label", F.coalesce("component", "label").alias("component"))
    # A label that phase one joined nothing to is its only member's key.
    return ends.select(F.coalesce("key", "label").alias("key"), "component")


def _paragraphs(read: DataFrame, rows: DataFrame, similarity: float, least_words: int) -> DataFrame:
    """Lines of which an equal or similar one comes earlier."""
    found = read.select("doc_id", "n", "same", F.posexplode(F.arrays_zip(*LINE)).alias("pos", "l")).select("doc_id", "n", "same", "pos", "l.*")
    place = F.struct("doc_id", "n", "pos", "start")
    first = found.groupBy("key").agg(F.min(F.struct("doc_id", "n", "pos", "same")).alias("at"), F.min("key2").alias("least"), F.max("key2").alias("most"), F.min("bands").alias("bands"))
    # Different lines of one hash aren't taken for equal, nor compared.
    first = first.where("least = most").select("key", "at.doc_id", "at.same", "at.pos", "bands")
    classes = cut(_classes(cut(first), rows, similarity, least_words))
    release(rows.sparkSession)
    all_ = _join(found.select("doc_id", "n", "pos", "start", "end", "n_words", "key", "key2"), classes, "key", "left")
    all_ = cut(all_.withColumn("key2", F.when(F.col("component").isNull(), F.col("key2")).otherwise(0)).withColumn("component", F.coalesce("component", "key")).drop("key"))
    heads = all_.groupBy("component", "key2").agg(F.min(place).alias("kept"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    gone = _dealt(all_, "component").join(_dealt(heads, "component"), ["component", "key2", "h"]).where("n != kept.n OR pos != kept.pos")
    return gone.select("doc_id", "start", "end", "n_words", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"), F.lit("paragraph").alias("unit"))


# Stretches.


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds rank: rows (doc_id, n, same) numbered by doc_id (null first) and n."""
    bits = 33  # of a number within a partition
    rows = cut(rows.repartitionByRange("doc_id", "n").sortWithinPartitions("doc_id", "n").withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", bits).alias("part")
    before, offsets = 0, []
    for p, n in sorted(tuple(r) for r in rows.groupBy(part).count().collect()):  # a row a partition
        offsets.append((p, before))
        before += n
    offset = rows.sparkSession.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + F.col("m").bitwiseAND(F.lit((1 << bits) - 1))
    return rows.withColumn("part", part).join(F.broadcast(offset), "part").select("doc_id", "same", rank.alias("rank"))


def _word(place: str) -> Column:
    return F.col(place).bitwiseAND(F.lit((1 << WORD) - 1)).cast("int")


def _stretches(read: DataFrame, rows: DataFrame, similarity: float, least_passage: int) -> DataFrame:
    """Stretches of words each of which comes earlier, in any row; equal texts are one."""
    firsts = read.groupBy("same").agg(F.min(F.struct("doc_id", "n")).alias("at")).select("same", "at.doc_id", "at.n")
    ranked = cut(_ranked(firsts))
    marked = read.select("same", F.explode(F.arrays_zip("marks", "keys")).alias("x")).select("same", F.col("x.marks").alias("word"), F.col("x.keys").alias("key"))
    place = F.xxhash64("same", "word")
    again = marked.groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low != high").select("key")
    hits = cut(_join(marked, again, "key").distinct())
    del again, marked
    release(rows.sparkSession)
    located = cut(_join(hits, ranked, "same").select("key", F.shiftleft("rank", WORD).bitwiseOR(F.col("word").cast("long")).alias("place")))
    kept = located.groupBy("key").agg(F.min("place").alias("kept"))
    pairs = _join(located, kept, "key").where("place != kept")
    inside = F.shiftleft(F.col("place").bitwiseAND(F.lit(BLOCK - 1)), CELL).bitwiseOR(F.col("kept").bitwiseAND(F.lit(BLOCK - 1))).cast("int")
    pairs = pairs.select(F.shiftright("place", CELL).alias("cell"), F.shiftright("kept", CELL).alias("other"), inside.alias("inside"))
    pairs = cut(pairs.groupBy("cell", "other").agg(F.collect_set("inside").alias("anchors")))  # places within two blocks

    del hits, located, kept
    release(rows.sparkSession)
    cells = pairs.select("cell").unionByName(pairs.select(F.col("other").alias("cell"))).distinct()
    cells = cells.groupBy(F.shiftright("cell", WORD - CELL).alias("rank")).agg(F.collect_set(F.col("cell").bitwiseAND(F.lit((1 << WORD - CELL) - 1)).cast("int")).alias("blocks"))

    def blocks() -> Callable[..., tuple]:
        def row(text: bytes, rank: int, blocks: list[int]) -> tuple:
            own = (hashed(text)[2] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            parts = ((b, max(0, b * BLOCK - AROUND)) for b in sorted(blocks))
            return ([{"cell": rank << WORD - CELL | b, "first": first, "words": own[first : (b + 1) * BLOCK + AROUND]} for b, first in parts],)

        return row

    part = "array<struct<cell: long, first: int, words: array<int>>>"
    parts = map_rows(_met(rows, cells.join(ranked, "rank"), "rank", "blocks"), blocks, f"cells {part}").select(F.explode("cells").alias("x")).select("x.*")
    # Rows of one doc_id and text give the same.
    parts, path = written(parts.dropDuplicates(["cell"]), "blocks")
    release(rows.sparkSession)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_text, least = (1 << WORD - CELL) - 1, min(least_passage, AROUND)
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            cell, other, first, other_first = (batch.column(k).to_numpy() for k in range(4))
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in batch.columns[4:]]
            for k in range(batch.num_rows):
                anchors, own, others = (values[at[k] : at[k + 1]] for at, values in lists)
                a, b = (int(c[k] & in_text) * BLOCK - int(f[k]) for c, f in ((cell, first), (other, other_first)))
                for s, e, j in alike(own, others, (anchors >> CELL) + a, (anchors & BLOCK - 1) + b, least, similarity):
                    start = int(first[k])
                    for col, value in zip(out, (int(cell[k]) >> WORD - CELL, start + s, start + e, (int(other[k]) >> WORD - CELL) << WORD | int(other_first[k]) + j), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["rank", "a", "b", "kept"])

    laid = _join(_join(pairs, parts, "cell"), parts.withColumnsRenamed({"cell": "other", "first": "other_first", "words": "others"}), "other")
    found = small_batches(laid.select("cell", "other", "first", "other_first", "anchors", "words", "others")).mapInArrow(lay, "rank long, a int, b int, kept long")
    found = cut(found.groupBy("rank").agg(F.collect_set(F.struct("a", "b", "kept")).alias("found")))
    remove(rows.sparkSession, path)

    def runs() -> Callable[..., tuple]:
        names = ("a", "b", "kept")

        def row(rank: int, found: list[dict]) -> tuple:
            whole = merged([(x["a"], x["b"], x["kept"]) for x in found])
            return rank, [dict(zip(names, x, strict=True)) for x in whole if x[1] - x[0] >= least_passage]

        return row

    found = cut(map_rows(found, runs, "rank long, runs array<struct<a: int, b: int, kept: long>>").where("size(runs) > 0"))
    # Code points are read off the texts, those of the kept ones' starts too.
    own = found.select("rank", F.explode("runs").alias("x")).select("rank", "x.*")
    asked = own.select("rank", F.explode(F.array("a", F.col("b") - 1)).alias("word"))
    asked = asked.unionByName(own.select(F.shiftright("kept", WORD).alias("rank"), _word("kept").alias("word")))
    asked = asked.groupBy("rank").agg(F.collect_set("word").alias("asked"))

    def places() -> Callable[..., tuple]:
        names = ("word", "start", "end")

        def row(text: bytes, rank: int, asked: list[int]) -> tuple:
            starts, ends, _ = hashed(text)
            asked = [w for w in asked if w < len(starts)]
            return rank, [dict(zip(names, x, strict=True)) for x in zip(asked, points(text, starts[asked]).tolist(), points(text, ends[asked]).tolist(), strict=True)]

        return row

    met = map_rows(_met(rows, asked.join(ranked, "rank"), "rank", "asked"), places, "rank long, at array<struct<word: int, start: int, end: int>>").dropDuplicates(["rank"])
    places_ = cut(met.select(F.shiftleft("rank", WORD).alias("base"), F.explode("at").alias("x")).select(F.col("base").bitwiseOR(F.col("x.word").cast("long")).alias("place"), "x.start", "x.end"))
    base = F.shiftleft("rank", WORD)
    own = own.select("rank", "kept", (F.col("b") - F.col("a")).alias("n_words"), base.bitwiseOR(F.col("a").cast("long")).alias("from"), base.bitwiseOR((F.col("b") - 1).cast("long")).alias("upto"))
    own = own.join(places_.select(F.col("place").alias("from"), "start"), "from").join(places_.select(F.col("place").alias("upto"), "end"), "upto")
    own = _join(own, places_.select(F.col("place").alias("kept"), F.col("start").alias("kept_start")), "kept").withColumn("head", F.shiftright("kept", WORD))
    heads = ranked.select(F.col("rank").alias("head"), F.col("doc_id").alias("kept_doc_id"))
    gone = _join(own.join(ranked.select("rank", "doc_id"), "rank"), heads, "head")
    return gone.select("doc_id", "start", "end", "n_words", "kept_doc_id", "kept_start", F.lit("stretch").alias("unit"))


def repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, least_passage: int = LEAST_PASSAGE
) -> DataFrame:
    """doc_id, start, end, n_words, kept_doc_id, kept_start, unit: a row for each piece of text to remove.

    unit text: a text of least_words or more words that an earlier row has, by doc_id (null first); unit paragraph: a
    line of least_words or more words, of whose component another occurrence comes earlier, by doc_id and line; unit
    stretch: words, wherever they begin and end, that are similar to earlier ones, be they of the same row, and
    least_passage or more. Runs of LEAST_PASSAGE equal words are always found, and what a similar passage has besides
    such a run; copies of a text have no stretches of their own. Pieces may overlap; what goes is their union.

    start and end are code points, end exclusive. Words count without case and punctuation; shingles have five words,
    and fewer words are one. Null and empty texts have no words and so none of the units; repeated rows are copies, of
    which one is kept; of a word that fills a text the first stays; no rows give no rows. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    read, path = _read(rows, least_words)
    spark, found = rows.sparkSession, []
    for part in (lambda: _copies(read, least_words), lambda: _stretches(read, rows, similarity, least_passage), lambda: _paragraphs(read, rows, similarity, least_words)):
        found.append(cut(part()))
        release(spark)
    remove(spark, path)
    return found[0].unionByName(found[1]).unionByName(found[2])
