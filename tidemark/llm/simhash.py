"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments (three, for four differing bits) that in one of them two linked
fingerprints differ by at most one bit. Every segment is indexed once per bit with that bit wildcarded: linked
fingerprints share such a variant, so an equality join finds them and a popcount verifies them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, map_rows, release, utf8, without
from tidemark.llm.components import components

BITS, MAX_BITS, SEED, WIDTH = 64, 4, 42, 4

#: Fingerprints of a variant from which on it's looked at whether they have one label.
MANY = 64

#: Shingles hashed at a time, which bounds a very long document's memory.
BLOCK = 50_000


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """As a signed long: bit i is set if it's set in over half of the shingles' hashes; no word: 0."""
    tokens = text.lower().split()  # of bytes: lower-cases A-Z only, splits at \x20 and \x09-\x0D only
    if not tokens:
        return 0
    width = min(width, len(tokens))
    n, ones, digest = len(tokens) - width + 1, np.zeros(BITS), xxhash.xxh64_digest
    for k in range(0, n, BLOCK):
        block = tokens[k : k + min(BLOCK, n - k) + width - 1]
        hashes = b"".join([digest(x, SEED) for x in map(b" ".join, zip(*(block[i:] for i in range(width)), strict=False))])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += np.ones(len(bits), np.float32) @ bits.astype(np.float32)  # counts up to BLOCK are exact in float32
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), a row for each row. Null and empty texts: 0."""

    def make() -> Callable[..., tuple]:
        return lambda i, text: (i, fingerprint(text, width))

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col))), make, "doc_id long, fp long")


def segments(max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """(shift, bits) of the fewest segments of which one differs by at most one bit: max_bits < 2 * their number."""
    n = max_bits // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _part(fp: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))


def variants(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Adds key, one for each bit of the fingerprint: that bit's place and its segment's other bits."""
    keys = [
        _part(F.col("fp"), shift, bits).bitwiseAND(F.lit(~(1 << i))).bitwiseOR(F.lit((shift + i) << 48))
        for shift, bits in segments(max_bits)
        for i in range(bits)
    ]
    return fps.withColumn("key", F.explode(F.array(*keys)))


def _near(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def _first_shared(a: Column, b: Column, key: Column, max_bits: int) -> Column:
    """Whether key is the first variant that a and b share, so that a pair is met once."""
    place, out = F.shiftright(key, 48).cast("int"), F.lit(False)
    for shift, bits in reversed(segments(max_bits)):
        off = _part(a.bitwiseXOR(b), shift, bits)
        first = F.when(off == 0, place == shift).otherwise(off == F.expr("shiftleft(1L, int(shiftright(key, 48)) - %d)" % shift))
        out = F.when(F.bit_count(off) <= 1, first).otherwise(out)
    return out


def _pivots(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) from fingerprints to a few pivots of those with an equal segment: no group's pairs are all made,
    and yet most of a large group of near copies comes together."""
    cuts = segments(max_bits)
    keyed = fps.select("fp", F.explode(F.array(*(_part(F.col("fp"), *c).bitwiseOR(F.lit(i << 48)) for i, c in enumerate(cuts)))).alias("key"))
    mixed = F.struct(F.xxhash64("fp"), "fp")
    pivots = keyed.groupBy("key").agg(F.min("fp").alias("p0"), F.max("fp").alias("p1"), F.min(mixed).alias("p2"), F.max(mixed).alias("p3"))
    pivots = pivots.where("p0 != p1").select("key", F.array("p0", "p1", "p2.fp", "p3.fp").alias("pivots"))
    # Dealt out by a second key too, so that the adaptive planner can split a hot segment.
    met = keyed.withColumn("h", F.xxhash64("key")).join(pivots.withColumn("h", F.xxhash64("key")), ["key", "h"])
    near = F.filter("pivots", lambda p: (p != F.col("fp")) & _near(p, F.col("fp"), max_bits))
    return met.select(F.col("fp").alias("a"), F.explode(near).alias("b"))


def clusters(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints (fp) -> fp, component (a fingerprint of the component).

    Links to pivots come first and give each fingerprint a label. Then the index's equality join meets every two
    fingerprints that share a variant, and keeps those that link different labels: none of these is lost, and what
    the pivots have joined isn't made again.
    """
    first = cut(components(_pivots(fps.select("fp"), max_bits)))
    label = F.coalesce("component", "fp").alias("label")
    labelled = cut(fps.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", label))
    a = variants(labelled, max_bits)
    # Where many fingerprints share a variant and a label, it links nothing anew, and their pairs needn't be looked at.
    plain = a.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where((F.col("n") > MANY) & (F.col("low") == F.col("high")))
    a = without(a, plain, "key")
    release(fps.sparkSession)
    b = a.select("key", F.col("fp").alias("other"), F.col("label").alias("other_label"))
    fp, other = F.col("fp"), F.col("other")
    verified = (fp < other) & _near(fp, other, max_bits) & (F.col("label") != F.col("other_label")) & _first_shared(fp, other, F.col("key"), max_bits)
    links = a.join(b, "key").where(verified).select(F.col("label").alias("a"), F.col("other_label").alias("b"))
    second = components(links)
    return labelled.join(second.withColumnRenamed("node", "label"), "label", "left").select("fp", F.coalesce("component", "label").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links), a row for each row.

    Copies collapse to their fingerprint before anything is joined. Null, empty and blank texts have fingerprint 0
    and so are one group; a row without doc_id keeps its fingerprint's component; repeated rows stay repeated;
    no rows give no rows. Other columns aren't read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = cut(clusters(distinct, max_bits).join(distinct, "fp"))
    heads = found.groupBy("component").agg(F.min("least").alias("component_id"))
    # A component may have very many fingerprints, and a fingerprint a third of all rows: a second key makes both
    # sides be dealt out anew, so that the planner can split either.
    named = found.withColumn("h", F.xxhash64("component")).join(heads.withColumn("h", F.xxhash64("component")), ["component", "h"])
    named = named.select("fp", "component_id").withColumn("h", F.xxhash64("fp"))
    return prints.withColumn("h", F.xxhash64("fp")).join(named, ["fp", "h"]).select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
