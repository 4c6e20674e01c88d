"""Exact top-k by inner product with M-trees: paged metric nodes, best-first search, stored triangle bounds.

Rows are dealt evenly over shards of bounded size, each with a tree of its own. A tree's nodes are pages; an entry keeps
its covering radius and its distance to the node's own centre. With |x - p| <= r, the product <q, x> is at most
<q, p> + |q| r, so a stored distance rules entries out without another product, and pages are read best bound first.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Rows of a shard and of a page, entries of an inner page, queries of a block.
SHARD, PAGE, FANOUT, BLOCK = 8192, 1024, 16, 256

#: Blocks of queries that a task takes to a shard.
BLOCKS = 64


@dataclass
class Node:
    """A page: either rows (ids, vectors) or children. reach: each entry's distance to centre, for a child with its radius."""

    centre: np.ndarray
    radius: float
    least_id: int
    reach: np.ndarray
    ids: np.ndarray | None = None
    rows: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None


def build(ids: np.ndarray, rows: np.ndarray) -> Node:
    """Bulk load: centres far from one another, every row with the nearest one, until a page holds a cluster."""
    centre = rows[0]
    far = np.sqrt(((rows - centre) ** 2).sum(axis=1), dtype=float)
    radius = float(far.max())
    if len(rows) <= PAGE or not radius:
        # Equal rows can't be told apart by distance: they fill pages by id.
        parts = [slice(k, k + PAGE) for k in range(0, len(rows), PAGE)]
        leaves = [Node(centre, float(far[s].max()), int(ids[s].min()), far[s], ids[s], rows[s]) for s in parts]
        if len(leaves) == 1:
            return leaves[0]
        return _above(centre, radius, leaves)
    near, nearest = np.full(len(rows), np.inf), np.zeros(len(rows), dtype=int)
    pick = int(far.argmax())
    for k in range(min(FANOUT, -(-len(rows) // PAGE) + 1)):
        gap = np.sqrt(((rows - rows[pick]) ** 2).sum(axis=1))
        nearest[gap < near] = k
        near = np.minimum(near, gap)
        pick = int(near.argmax())
        if not near[pick]:
            break
    groups = [np.flatnonzero(nearest == k) for k in np.unique(nearest)]
    if len(groups) == 1:
        half = np.argsort(far, kind="stable")
        groups = [half[: len(half) // 2], half[len(half) // 2 :]]
    return _above(centre, radius, [build(ids[g], rows[g]) for g in groups])


def _above(centre: np.ndarray, radius: float, children: list[Node]) -> Node:
    centres = np.array([c.centre for c in children])
    apart = np.sqrt(((centres - centre) ** 2).sum(axis=1), dtype=float)
    reach = apart + np.array([c.radius for c in children])
    return Node(centre, radius, min(c.least_id for c in children), reach, children=children, centres=centres)


def search(root: Node, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id), ties to smaller ids, of the rows whose id isn't own."""
    size = float(np.sqrt(query @ query))
    if root.centre.dtype == np.float32 and size**2 < 2**24:  # and so are all products
        query = query.astype(np.float32)
    best = np.empty((2, 0))  # scores and negated ids, best first
    worst = (-np.inf, -np.inf)
    slack = lambda bound: np.floor(bound + 1e-9 * (1 + np.abs(bound)) + 1e-6)  # noqa: E731  products are whole numbers

    def out(bound: float, least_id: int) -> bool:
        return (bound, -least_id) <= worst

    at = float(query @ root.centre)
    heap = [(-float(slack(at + size * root.radius)), 0, at, root)]
    made = 1
    while heap:
        bound, _, at, node = heapq.heappop(heap)
        if out(-bound, node.least_id):
            if -bound < worst[0]:
                break
            continue
        bounds = slack(at + size * node.reach)
        if node.children:
            # The stored distances first; only children that they leave are multiplied with.
            left = [i for i, c in enumerate(node.children) if not out(float(bounds[i]), c.least_id)]
            if left:
                products = node.centres[left] @ query
                for i, product in zip(left, products.tolist(), strict=True):
                    child = node.children[i]
                    tight = min(float(bounds[i]), float(slack(product + size * child.radius)))
                    if not out(tight, child.least_id):
                        heapq.heappush(heap, (-tight, made, product, child))
                        made += 1
            continue
        left = np.flatnonzero(bounds >= worst[0])
        some = len(left) < len(node.ids) // 2  # else the page as it is: picking rows would copy most of it
        scores, ids = ((node.rows[left], node.ids[left]) if some else (node.rows, node.ids))
        scores = scores @ query
        keep = np.flatnonzero((scores >= worst[0]) & (ids != own))
        if len(keep) > k:
            least = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
            keep = keep[scores[keep] >= least]
        if len(keep):
            both = np.hstack([best, [scores[keep], -ids[keep]]])
            best = both[:, np.lexsort((-both[1], -both[0]))[:k]]
            if best.shape[1] == k:
                worst = tuple(best[:, -1])
    return [(int(s), int(-i)) for s, i in best.T]


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """vec_id, x (array of double, whole numbers): floor(scale * component). Rows without id, and vectors that are null
    or hold null or non-finite components, are left out."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    sound = "vec_id IS NOT NULL AND x IS NOT NULL AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity'))"
    return rows.where(sound).select("vec_id", F.expr(f"transform(x, v -> double(floor({scale}D * v)))").alias("x"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for rows whose id is divisible by every, the k largest inner products.

    Candidates are all rows with another id and as many components; ties go to the smaller id, repeated rows count as
    often as they are there, equal queries once; an empty vector has product 0 with others. Fewer than k candidates are
    all returned; no rows give no rows. A vector of very many components is a row, and so fits in one.
    Scores have to be below 2 ** 53. Other columns aren't read.
    """
    rows = cut(quantised(vectors, id_col, vec_col, scale))
    shards = max(1, -(-rows.count() // SHARD))
    # Dealt out by place, not by key: equal ids or vectors can't gather in a shard.
    dealt = rows.withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int")).withColumn("size", F.size("x"))

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        rows = np.stack(group["x"].to_numpy()).astype(float)
        # Whole numbers whose sums stay below 2 ** 24 are exact in single precision too.
        rows = rows.astype(np.float32) if len(rows[0]) and (rows**2).sum(axis=1).max() < 2**24 else rows
        tree = build(group["vec_id"].to_numpy(), rows)
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "size": group["size"].iloc[:1], "tree": [pickle.dumps(tree, protocol=5)]})

    trees = dealt.groupBy("shard", "size").applyInPandas(plant, "shard int, size int, tree binary")
    queries = rows.where(F.col("vec_id") % every == 0).distinct().withColumn("size", F.size("x"))
    blocks = -(-queries.count() // BLOCK) or 1
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int"))
    packed = queries.groupBy("size", "block").agg(F.collect_list(F.struct("vec_id", "x")).alias("queries"))
    # A stated query set against all rows: each block of queries meets each shard's tree once, some blocks a task.
    parts = -(-blocks // BLOCKS)
    packed = packed.withColumn("part", F.col("block") % parts).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    trees = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, Node] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("tree")[i].as_py()
                if last is None or last[0] != raw:
                    last = raw, pickle.loads(raw)
                out = []
                for q in batch.column("queries")[i].as_py():
                    x = np.array(q["x"], dtype=float)
                    key = xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63
                    out += [(q["vec_id"], key, i, s) for s, i in search(last[1], x, q["vec_id"], k)]
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "key", "vec_id", "score"])

    found = packed.join(trees, ["size", "shard", "part"]).select("queries", "tree").mapInArrow(run, "query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
