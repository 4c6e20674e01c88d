"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, release


def _joined(edges: DataFrame, mins: DataFrame) -> DataFrame:
    """edges with the least neighbour of u. The second key makes both sides be dealt out anew, so that the
    adaptive planner can split a u that has very many edges."""
    return edges.withColumn("h", F.xxhash64("u")).join(mins.withColumn("h", F.xxhash64("u")), ["u", "h"])


def _least(u: Column, v: Column, edges: DataFrame) -> DataFrame:
    return edges.groupBy(u.alias("u")).agg(F.min(v).alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def components(pairs: DataFrame) -> DataFrame:
    """pairs (a, b: long) -> node, component (the smallest node reachable), for every node of a pair of two nodes.

    A hot node's edges are only ever pre-aggregated to a minimum or split by a join. Pairs with a null don't link;
    repeated and self pairs change nothing; no pairs give no rows. Each round's edges are a star-ward rewrite of the
    last, so their number doesn't grow; rounds end when the edges stay as they are.
    """
    edges = cut(
        pairs.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(F.col("u"), F.least("u", "v"), both)
        large = _joined(both, least).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least(F.col("u"), F.col("v"), large)
        small = _joined(large, least).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.distinct())
        state, before = _state(edges), state
        release(edges.sparkSession)  # the last round's files
        if state == before:
            break
    # Every edge now runs from a node to the least of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
