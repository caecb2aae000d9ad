"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt to shards by a hash of their id. In a shard a tree is built by median splits along the widest side of the
points' own bounding box; every node keeps that tight box. For a query q, no point of a box scores above the sum of
max(q_i * low_i, q_i * high_i), so nodes are visited best bound first and a search ends when the best bound is below the k-th
score. A first pass searches one shard per query; then the shards are searched in rounds, each with twice as many as the one before, and the k-th score of
all rounds so far is the starting bound of the next. A round with as many shards as were searched before finds about k better points for a query, so the hits of
a query grow with the logarithm of the number of shards.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; a score is defined between vectors of
equal length only, shards hold one length each; rows with a null id take no part; rows with equal id are candidates of each
other and of others one by one ("own row" is the id); ties go to the smaller id. Components beyond +-2**53 are refused,
because their products have no place in a long.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwatch.llm.common import table
from shelfwatch.session import cut_lineage

NODES = "shard long, node int, left int, right int, low binary, high binary, ids binary, points binary"
HITS = "query_id long, vec_id long, score long"


def quantise(vectors: DataFrame, column: str, scale: int = 256) -> DataFrame:
    """(vec_id, point array<long>): floor(scale * component) of every vector that is fit to be compared."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    usable = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & F.col("vec_id").isNotNull()).where(finite)

    def floor(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * F.lit(float(scale)))
        return F.when(F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(float(2**53)), scaled).otherwise(F.raise_error(F.lit("component beyond 2**53")).cast("long"))

    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, floor).alias("point"))


def deal(points: DataFrame, per_shard: int) -> DataFrame:
    """`points` with a shard: vectors of one length, about `per_shard` of them, so that the number of shards follows the data."""
    lengths = points.groupBy(F.size("point").alias("length")).agg(F.count("*").alias("n"))
    lengths = lengths.select("length", F.ceil(F.col("n") / F.lit(per_shard)).cast("long").alias("shards"))
    dealt = points.withColumn("length", F.size("point")).join(lengths, "length")
    part = F.pmod(F.xxhash64("vec_id"), F.col("shards"))
    return dealt.withColumn("shard", F.col("length").cast("long") * F.lit(1 << 32) + part)


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: floating point where it is exact, Python's numbers (within a long) where it might not be."""
    most = (int(np.abs(a).max(initial=0)) or 1) * (int(np.abs(b).max(initial=0)) or 1) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def build_tree(ids: np.ndarray, points: np.ndarray, leaf_size: int) -> list[tuple]:
    """Nodes (node, left, right, low, high, ids, points); the inner ones have no points, leaves have -1 for children."""
    nodes, todo = [], [(0, np.arange(len(ids)))]
    made = 1
    while todo:
        number, rows = todo.pop()
        box = points[rows]
        low, high = box.min(axis=0), box.max(axis=0)
        axis = int(np.argmax(high - low))
        if len(rows) <= leaf_size or low[axis] == high[axis]:
            nodes.append((number, -1, -1, low, high, ids[rows], box))
            continue
        order = np.argpartition(box[:, axis], len(rows) // 2)
        nodes.append((number, made, made + 1, low, high, ids[:0], box[:0]))
        todo += [(made, rows[order[: len(rows) // 2]]), (made + 1, rows[order[len(rows) // 2 :]])]
        made += 2
    return sorted(nodes, key=lambda n: n[0])


def search_tree(nodes: list[tuple], own: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int):
    """(query's id, point's id, score) of all that can still be among the k best, given each query's k-th score so far."""
    low, high = np.stack([n[3] for n in nodes]), np.stack([n[4] for n in nodes])
    upper = exact_dot(np.maximum(queries, 0), high) + exact_dot(np.minimum(queries, 0), low)
    for q, (me, floor) in enumerate(zip(own, bounds)):
        best: list[tuple[int, int]] = []  # (score, -id): the worst of the kept is first
        heap = [(-int(upper[q, 0]), 0)]
        while heap:
            bound, at = heapq.heappop(heap)
            if -bound < floor:
                break
            node = nodes[at]
            if node[1] >= 0:
                for child in node[1:3]:
                    if upper[q, child] >= floor:
                        heapq.heappush(heap, (-int(upper[q, child]), child))
                continue
            scores = exact_dot(queries[q : q + 1], node[6])[0]
            for i in np.flatnonzero((scores >= floor) & (node[5] != me)):
                item = (int(scores[i]), -int(node[5][i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                floor = max(floor, best[0][0])
        for score, other in best:
            yield int(me), -other, score


def grow_trees(dealt: DataFrame, leaf_size: int = 128) -> DataFrame:
    """One row per node of every shard's tree."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = build_tree(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["point"].to_numpy()).astype(np.int64), leaf_size)
        rows = [(int(pdf["shard"].iloc[0]), n, a, b, *(x.astype(np.int64).tobytes() for x in (low, high, ids, points))) for n, a, b, low, high, ids, points in nodes]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])

    return dealt.select("shard", "vec_id", "point").groupBy("shard").applyInPandas(grow, NODES)


def search_shards(trees: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The hits of `asked` (shard, block, query_id, point, bound) in the shards they name.

    A group is one block of queries at one shard: its nodes are repeated for each block that asks it, and a task holds one
    tree and one block.
    """

    def search(tree: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        hits: list[tuple] = []
        if len(tree) and len(wanted):
            read = lambda b: np.frombuffer(b, np.int64)
            nodes = [(n, a, b, low := read(lo), read(hi), read(ids), read(pts).reshape(-1, len(low))) for n, a, b, lo, hi, ids, pts in tree.sort_values("node")[["node", "left", "right", "low", "high", "ids", "points"]].itertuples(index=False)]
            for start in range(0, len(wanted), 256):
                part = wanted.iloc[start : start + 256]
                hits += search_tree(nodes, part["query_id"].to_numpy(np.int64), np.stack(part["point"].to_numpy()).astype(np.int64), part["bound"].to_numpy(np.int64), k)
        return pd.DataFrame(hits, columns=["query_id", "vec_id", "score"]).astype("int64")

    asking = asked.select(F.col("shard").alias("at"), F.col("block").alias("by")).distinct()
    repeated = trees.join(asking, F.col("shard") == F.col("at")).select(*trees.columns, F.col("by").alias("block")).groupBy("shard", "block")
    wanted = asked.select("shard", "block", "query_id", "point", "bound").groupBy("shard", "block")
    return repeated.cogroup(wanted).applyInPandas(search, HITS)


def in_blocks(queries: DataFrame, by: list[str], block: int) -> DataFrame:
    """`queries` with a block, of at most `block` queries of equal `by`.

    They are dealt to cells of nearly that size by hash; what one has above it is a block of its own.
    """
    cells = queries.groupBy(*by).agg(F.ceil(1.1 * F.count("*") / F.lit(block)).cast("long").alias("cells"))
    dealt = queries.join(cells, by).withColumn("cell", F.pmod(F.xxhash64("query_id"), F.col("cells")))
    order = Window.partitionBy(*by, "cell").orderBy("query_id", "point")
    number = F.floor((F.row_number().over(order) - 1) / F.lit(block)).cast("long")
    return dealt.withColumn("block", F.col("cell") + number * F.col("cells")).drop("cells", "cell")


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, column: str, is_query: Column, k: int = 5, scale: int = 256, per_shard: int = 8192, leaf_size: int = 128, block: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of every query.

    The queries meet every shard of their length in blocks of at most `block`; a task holds one shard's tree and one block at a time.
    """
    dealt = cut_lineage(deal(quantise(vectors, column, scale), per_shard))
    trees = cut_lineage(grow_trees(dealt, leaf_size))
    lowest = F.lit(-(2**63)).cast("long")
    queries = dealt.where(is_query).dropDuplicates(["vec_id", "point"]).select(F.col("vec_id").alias("query_id"), "point", "length", "shards", F.col("shard").alias("home"))
    best = cut_lineage(search_shards(trees, in_blocks(queries, ["home"], block).withColumns({"shard": F.col("home"), "bound": lowest}), k))
    blocked = cut_lineage(in_blocks(queries, ["length"], block).withColumn("base", F.col("length").cast("long") * F.lit(1 << 32)))
    most = dealt.agg(F.max("shards")).first()[0] or 0
    first, width = 0, 1
    while first < most:
        bounds = best_hits(best, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
        parts = F.sequence(F.lit(first).cast("long"), F.least(F.lit(first + width).cast("long"), F.col("shards")) - 1)
        asked = blocked.where(F.col("shards") > first).withColumn("part", F.explode(parts)).withColumn("shard", F.col("base") + F.col("part")).where("shard <> home")
        asked = asked.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", lowest))
        best = cut_lineage(best_hits(best.unionByName(search_shards(trees, asked, k)), k).drop("rank"))
        first, width = first + width, 2 * width
    return best_hits(best, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), "embedding", F.col("vec_id") % 50 == 0)


OP7_SQL = """
with v as (select vec_id, [cast(floor(256 * x::double) as bigint) for x in embedding] as p from embeddings
           where embedding is not null and vec_id is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum([q.p[i] * c.p[i] for i in range(1, len(q.p) + 1)]) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.p) = len(c.p))
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 5
"""
