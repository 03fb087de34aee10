"""Hard-negative mining with bounds along a spanning tree of the anchors (operator 12).

A row's score is its inner product with an anchor. Two anchors at distance d score a
candidate c within d times the norm of c of each other. So the anchors of a block are
joined by a minimal spanning tree; the root scores every candidate of a shard, and each
further anchor takes its parent's score plus and minus edge length times norm as bounds.
Only candidates whose bounds overlap the scores that are asked for are scored anew; the
others hand their bounds on to the anchor's children, widened by the next edge.

The search runs twice over (block of anchors, shard of candidates) pairs: first for the
positives, where the scores asked for are those from the ``n_positives``-th best so far
on, then for the negatives, where they are the windows that the positives' scores set.

Components are ``floor(scale * x)``; scores are whole numbers, exact below 2**63. Vectors
of other lengths count as filled up with zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import cut, table

#: Candidates of a shard and anchors of a block, about.
SHARD, BLOCK = 8192, 256

_PACKED = "part int, ids array<long>, labels binary, vectors binary"
_POSITIVE = ["anchor_id", "positive_id", "score"]
_NEGATIVE = ["anchor_id", "place", "positive_id", "negative_id", "positive_score", "negative_score"]


class Packed(NamedTuple):
    """Rows side by side: ids, labels, and a matrix of whole numbers."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def unpack(ids: list[int], labels: bytes, vectors: bytes) -> Packed:
    return Packed(np.array(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(vectors, np.int64).reshape(len(ids), -1))


def taking_part(vectors: DataFrame, scale: int = 256, every: int = 7, classes: int = 10) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; each ``every``-th id has the next label."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    label = F.col("label").cast("long")
    return vectors.where(fine).select(
        F.col("vec_id").cast("long"),
        F.when(F.col("vec_id") % every == 0, (label + 1) % classes).otherwise(label).alias("label"),
        F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("vector"),
    )


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Each partition of ``rows`` as packed rows of at most ``most`` vectors, numbered by partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                some = batch.slice(at, most)
                lists = some.column(3)
                sizes = np.diff(lists.offsets.to_numpy())
                matrix = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
                matrix[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
                ids = pa.array([some.column(1).to_pylist()], pa.list_(pa.int64()))
                blobs = [pa.array([b.tobytes()], pa.binary()) for b in (some.column(2).to_numpy(), matrix)]
                yield pa.RecordBatch.from_arrays([some.column(0).slice(0, 1), ids, *blobs], ["part", "ids", "labels", "vectors"])

    return rows.select(F.spark_partition_id().alias("part"), "vec_id", "label", "vector").mapInArrow(pack, _PACKED)


def spanning_tree(vectors: np.ndarray) -> list[tuple[int, int, float]]:
    """(node, parent, length) of a minimal spanning tree, parents first; the root's parent is -1."""
    n = len(vectors)
    x = vectors.astype(np.float64)
    length, parent, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    out, node = [], 0
    for _ in range(n):
        left[node] = False
        out.append((node, int(parent[node]), float(length[node])))
        far = np.sqrt(((x - x[node]) ** 2).sum(axis=1))
        nearer = left & (far < length)
        length[nearer], parent[nearer] = far[nearer], node
        node = int(np.argmin(np.where(left, length, np.inf)))
    return out


def scores_within(
    anchors: Packed, shard: Packed, wanted: Callable[[int], np.ndarray | None], window: Callable[[int, np.ndarray], tuple[float, float]]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, places in the shard, their scores): every wanted candidate with a score in the window is among them.

    ``wanted(anchor)`` marks candidates, or is None for an anchor to pass by. ``window``
    gets the anchor and lower bounds of the scores of what is wanted.
    """
    dims = min(anchors.vectors.shape[1], shard.vectors.shape[1])
    a, c = anchors.vectors[:, :dims], shard.vectors[:, :dims]
    greatest = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(dims, 1)
    norm = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    if greatest < 1 << 53:  # such sums are exact in doubles
        a, c = a.astype(np.float64), c.astype(np.float64)
    slack = 1 + 1e-9 * greatest  # what rounding may do to a bound
    tree = spanning_tree(anchors.vectors)
    children = np.bincount([p for _, p, _ in tree if p >= 0], minlength=len(tree))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for node, parent, length in tree:
        if parent < 0:
            low = (c @ a[node]).astype(np.float64)
            high = low.copy()
        else:
            reach = length * norm + slack
            low, high = bounds[parent][0] - reach, bounds[parent][1] + reach
            children[parent] -= 1
            if not children[parent]:
                del bounds[parent]
        if (mask := wanted(node)) is not None:
            least, most = window(node, low[mask])
            at = np.flatnonzero(mask & (high >= least) & (low <= most))
            scores = (c[at] @ a[node]).astype(np.int64)
            low[at] = high[at] = scores
            hit = (scores >= least) & (scores <= most)
            yield node, at[hit], scores[hit]
        if children[node]:
            bounds[node] = low, high


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _pairs(blocks: DataFrame, shards: DataFrame, n_shards: int, extra: list[str]) -> DataFrame:
    """Each block of anchors next to every shard of candidates."""
    asked = blocks.select(*[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "vectors")], *extra)
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    return asked.join(shards, "part").select("a_ids", "a_labels", "a_vectors", "ids", "labels", "vectors", *extra)


def mine(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``. An anchor's positives are its
    ``n_positives`` best rows of the same label and another id; negatives are the best rows
    of other labels whose score is between ``least`` and ``most`` hundredths of the
    positive's. Ties go to the smaller id. Rows without id, label or finite vector take no
    part; an empty table gives no rows. Each row is a candidate, so repeated rows count as
    often, under one id; of several rows with an anchor's id the one of least label and
    vector is the anchor. Other columns are ignored.
    """
    rows = cut(taking_part(vectors))
    count = rows.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not count:
        return rows.sparkSession.createDataFrame([], schema)
    n_shards = -(-count // SHARD)
    shards = cut(packed(rows.repartition(n_shards), 2 * SHARD))
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")
    n_blocks = -(-max(anchors.count(), 1) // BLOCK)
    # anchors of one label stand together, so edges are short
    blocks = cut(packed(anchors.repartitionByRange(n_blocks, "label", "vec_id"), BLOCK).withColumn("block", F.monotonically_increasing_id()))

    def batch_of(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
        columns = [np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def window(_: int, low: np.ndarray) -> tuple[float, float]:
            """From the least score that can still be among the best."""
            return (np.partition(low, -n_positives)[-n_positives] if len(low) >= n_positives else -np.inf), np.inf

        for batch in batches:
            for cells in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                asked, shard = unpack(*cells[:3]), unpack(*cells[3:])
                same = lambda i, asked=asked, shard=shard: (shard.labels == asked.labels[i]) & (shard.ids != asked.ids[i])
                out = []
                for node, at, scores in scores_within(asked, shard, same, window):
                    best = _first(shard.ids[at], scores, n_positives)
                    out.append((np.full(len(best), asked.ids[node]), shard.ids[at[best]], scores[best]))
                yield batch_of(out, _POSITIVE)

    near = _pairs(blocks, shards, n_shards, []).mapInArrow(positives, ", ".join(f"{c} long" for c in _POSITIVE))
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    chosen = cut(near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n_positives))

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *cells, told in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                asked, shard = unpack(*cells[:3]), unpack(*cells[3:])
                # by anchor: place, positive, its score, and the whole scores that least and most hundredths of it allow
                windows: dict[int, list[tuple[int, int, int, int, int]]] = {}
                for w in told:
                    s = w["score"]
                    windows.setdefault(w["anchor_id"], []).append((w["place"], w["positive_id"], s, -(-least * s // 100), most * s // 100))
                of = [windows.get(i, []) for i in asked.ids.tolist()]
                other = lambda i, asked=asked, shard=shard, of=of: shard.labels != asked.labels[i] if of[i] else None
                window = lambda i, _, of=of: (min(w[3] for w in of[i]), max(w[4] for w in of[i]))
                out = []
                for node, at, scores in scores_within(asked, shard, other, window):
                    for place, positive, s, low, high in of[node]:
                        inside = np.flatnonzero((scores >= low) & (scores <= high))
                        inside = inside[_first(shard.ids[at[inside]], scores[inside], n_negatives)]
                        told_by = [np.full(len(inside), x) for x in (asked.ids[node], place, positive)]
                        out.append((*told_by, shard.ids[at[inside]], np.full(len(inside), s), scores[inside]))
                yield batch_of(out, _NEGATIVE)

    of_block = blocks.select("block", F.explode("ids").alias("anchor_id")).join(chosen, "anchor_id")
    told = of_block.groupBy("block").agg(F.collect_list(F.struct("anchor_id", "place", "positive_id", "score")).alias("told"))  # BLOCK times n_positives at most
    far = _pairs(blocks.join(told, "block"), shards, n_shards, ["told"]).mapInArrow(negatives, ", ".join(f"{c} long" for c in _NEGATIVE))
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12(spark, sf_dir) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (
  SELECT vec_id, label, e FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label, e) AS n FROM v WHERE vec_id % 100 = 0) WHERE n = 1
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM a JOIN v c ON a.label <> c.label OR a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same
), r AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN scored USING (anchor_id)
  WHERE place <= 5 AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""
