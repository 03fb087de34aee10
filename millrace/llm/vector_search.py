"""Exact top-k search by inner product with KD-trees per shard (operator 2).

Vectors are dealt into shards of bounded size. A shard is a KD-tree: median splits along
the widest side, a tight box for every node. A query goes down best first by the greatest
inner product that a box allows, and stops when no box left can beat its kth score. Query
vectors come in blocks: each block first asks one shard, and its kth scores found there
travel with it to all other shards.

Components are ``floor(scale * x)``; scores are whole numbers and exact while they stay
below 2**63. Vectors of other lengths count as filled up with zeros.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import cut, table, union

#: Vectors of a shard, of a leaf and of a block of queries, about.
SHARD, LEAF, BLOCK = 8192, 256, 256
_HIT = "query_id long, vec_id long, score long, copies long"


@dataclass
class Node:
    low: np.ndarray
    high: np.ndarray
    ids: np.ndarray | None = None
    copies: np.ndarray | None = None
    vectors: np.ndarray | None = None
    left: Node | None = None
    right: Node | None = None


def tree(ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> Node:
    node = Node(vectors.min(axis=0), vectors.max(axis=0))
    side = int(np.argmax(node.high - node.low)) if vectors.shape[1] else 0
    if len(ids) <= LEAF or not vectors.shape[1] or node.low[side] == node.high[side]:
        node.ids, node.copies, node.vectors = ids, copies, vectors
        return node
    order = np.argsort(vectors[:, side], kind="stable")
    half = len(ids) // 2
    node.left, node.right = (tree(ids[part], copies[part], vectors[part]) for part in (order[:half], order[half:]))
    return node


def bound(node: Node, up: np.ndarray, down: np.ndarray) -> int:
    """The greatest inner product with any point of the box; up and down: positive and negative parts."""
    return int(up @ node.high + down @ node.low)


def search(root: Node, query_id: int, query: np.ndarray, k: int, least: int | None) -> list[tuple[int, int, int]]:
    """The k best (score, -vec_id, copies), less those that score below ``least``."""
    up, down = np.maximum(query, 0), np.minimum(query, 0)
    best: list[tuple[int, int, int]] = []  # a heap, the worst first
    queue, turn = [(-bound(root, up, down), 0, root)], 0
    while queue:
        top, _, node = heapq.heappop(queue)
        floor = best[0][0] if len(best) == k else least
        if floor is not None and -top < floor:
            break
        if node.vectors is None:
            for part in (node.left, node.right):
                turn += 1
                heapq.heappush(queue, (-bound(part, up, down), turn, part))
            continue
        scores = node.vectors @ query
        good = node.ids != query_id
        if floor is not None:
            good &= scores >= floor
        at = np.flatnonzero(good)
        at = at[np.lexsort((node.ids[at], -scores[at]))[:k]]
        for hit in zip(scores[at].tolist(), (-node.ids[at]).tolist(), node.copies[at].tolist(), strict=True):
            if len(best) < k:
                heapq.heappush(best, hit)
            elif hit > best[0]:
                heapq.heapreplace(best, hit)
    return best


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vector) of the rows that take part: an id, and only finite components."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(fine).select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("vector"))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each id divisible by ``every``.

    Ties go to the smaller vec_id. A row whose id equals the query's is its own and no
    candidate. Repeated rows are candidates as often as they come: they are searched once,
    with their number, and repeated before the rank is cut; a repeated query counts each
    of its pairs as often. Fewer candidates give fewer rows, an empty table none. Other
    columns are ignored.
    """
    rows = cut(whole_vectors(vectors).groupBy("vec_id", "vector").agg(F.count("*").alias("copies")))
    count, length = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    shards = max(1, -(-count // SHARD))
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // BLOCK))
    packed = F.collect_list(F.struct("vec_id", "vector", "copies"))
    shard_rows = rows.groupBy(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).alias("shard")).agg(packed.alias("rows"))
    block_rows = queries.groupBy(F.pmod(F.xxhash64("vector", "vec_id"), F.lit(blocks)).alias("block")).agg(packed.alias("rows"))

    def matrix(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = cell.values.field("vec_id").to_numpy()
        lists = cell.values.field("vector")
        sizes = np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(ids), length), np.int64)
        out[np.repeat(np.arange(len(ids)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        return ids, cell.values.field("copies").to_numpy(), out

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard's rows, block's rows, kth scores so far)."""
        for batch in batches:
            for cell, block, so_far in zip(*(batch.column(i) for i in range(3)), strict=True):
                root = tree(*matrix(cell))
                ids, times, asked = matrix(block)
                kth = dict(so_far.as_py() or [])
                hits = [(i, -v, s, n * m) for i, n, q in zip(ids.tolist(), times.tolist(), asked, strict=True) for s, v, m in search(root, i, q, k, kth.get(i))]
                yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in hits], pa.int64()) for c in range(4)], ["query_id", "vec_id", "score", "copies"])

    home = F.pmod(F.col("block"), F.lit(shards))
    asked = block_rows.select("block", F.col("rows").alias("asked"))
    none = F.lit(None).cast("map<long,long>")
    first = asked.withColumn("shard", home).join(shard_rows, "shard").select("rows", "asked", none.alias("kth")).mapInArrow(ask, _HIT)
    repeated = F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k))))
    first = cut(first)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("copy", repeated).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", "score")
    of_block = queries.select(F.col("vec_id").alias("query_id"), F.pmod(F.xxhash64("vector", "vec_id"), F.lit(blocks)).alias("block")).join(kth, "query_id")
    of_block = of_block.groupBy("block").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("query_id", "score")))).alias("kth"))
    others = asked.join(of_block, "block", "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).where(F.col("shard") != home)
    rest = others.join(shard_rows, "shard").select("rows", "asked", "kth").mapInArrow(ask, _HIT)
    best = union([first, rest]).withColumn("copy", repeated).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op2(spark, sf_dir) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
