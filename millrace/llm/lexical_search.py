"""Ranked lexical search with range-maximum sparse tables (operator 11).

Documents are read once. Every task turns them into pieces of an index: of some thousand
documents, where the terms of the items stand and how often. Counts over all pieces give
the weight of each term; from then on a posting has a fixed impact.

A piece answers an item best first. A posting list is sorted by document and has a sparse
table of range maxima over its impacts. For an interval of documents the sum of the lists'
maxima bounds every score inside. The interval of the greatest bound is taken next: the
document with the greatest single impact in it is scored, and what lies before and after
it become intervals of their own. An interval with few postings left is scored as a whole.
The search ends when no bound reaches the item's last kept score, which a task carries
from piece to piece.

Items come in blocks of bounded size, one pass each; only a block's terms are broadcast.
Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import textbytes as tb
from millrace.llm.shared import cut, table, union, width

#: Bytes of item texts in a block, bytes of text in a piece of the index (a longer text is a piece by itself).
ITEMS, PIECE = 1 << 23, 1 << 24
#: Postings of an interval that is scored as a whole.
LEAF = 2048

#: Bytes that end a term become blanks, A-Z become lower case.
_LETTERS = np.array([b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b | 32 if chr(b).isupper() else 32 for b in range(256)], np.uint8)

_PIECE = "n_docs long, n_terms long, ids binary, missing binary, sizes binary, terms binary, rows binary, times binary"


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text) of every term, and the number of terms of each text."""
    data = _LETTERS[data]
    w = tb.words(data, offsets)
    return tb.word_hashes(data, w), w.text, np.diff(w.first)


class Items(NamedTuple):
    """A block of items: for each, the places of its terms in the sorted vocabulary."""

    ids: list[int | None]
    vocabulary: np.ndarray
    terms: list[np.ndarray]


def read_items(rows: list[tuple[int | None, str | None]]) -> Items:
    texts: dict[int | None, set[int]] = {}
    for item, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        found, _, _ = terms(data, np.array([0, len(data)]))
        texts.setdefault(item, set()).update(found.tolist())
    vocabulary = np.array(sorted(set().union(*texts.values())), np.uint64)
    return Items(list(texts), vocabulary, [np.searchsorted(vocabulary, np.array(sorted(t), np.uint64)) for t in texts.values()])


def index(docs: DataFrame, items) -> DataFrame:
    """Pieces of the index over ``docs`` (doc_id, text) for the terms of a broadcast block of items."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        _, vocabulary, _ = items.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def piece() -> pa.RecordBatch:
            first = np.cumsum([0, *(len(h[0]) for h in held)])
            ids, missing, sizes, term, row, times = (np.concatenate([h[c] + (first[k] if c == 4 else 0) for k, h in enumerate(held)]) for c in range(6))
            order = np.lexsort((row, term))
            packed = [x.tobytes() for x in (ids, missing, sizes, term[order].astype(np.int32), row[order].astype(np.int32), times[order].astype(np.int32))]
            cells = [pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), *(pa.array([p], pa.binary()) for p in packed)]
            return pa.RecordBatch.from_arrays(cells, ["n_docs", "n_terms", "ids", "missing", "sizes", "terms", "rows", "times"])

        for batch in batches:
            for a, b, data, offsets in tb.blocks(batch.column(1)):
                hashes, text, sizes = terms(data, offsets)
                at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                hit = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                pair, times = np.unique(at[hit] * (b - a) + text[hit], return_counts=True)
                ids = batch.column(0).slice(a, b - a)
                held.append((ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()), sizes.astype(np.int64), pair // (b - a), pair % (b - a), times))
                size += len(data)
                if size >= PIECE:
                    yield piece()
                    held, size = [], 0
        if held:
            yield piece()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, _PIECE)


def frequencies(pieces: DataFrame) -> DataFrame:
    """(term, df): how many documents hold each term, summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                found = np.bincount(np.frombuffer(blob, np.int32))
                if len(found) > len(total):
                    total = np.r_[total, np.zeros(len(found) - len(total), np.int64)]
                total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["term", "df"])

    return pieces.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Piece:
    """Posting lists of some documents with sparse tables over their impacts."""

    def __init__(self, ids, sizes, term, row, times, weight: np.ndarray, n: int, length: int):
        self.ids, self.docs = ids, len(ids)
        m = 100 - 90 + (90 * sizes * n) // max(length, 1)
        self.row, self.impact = row, weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[row]))
        self.key = term * self.docs + row
        self.start = np.searchsorted(term, np.arange(len(weight) + 1))
        longest = int(np.diff(self.start).max(initial=0))
        self.best = [self.impact]  # best[k][i]: the greatest of 2**k impacts from i on
        while 2 << len(self.best) - 1 <= longest:
            last, step = self.best[-1], 1 << len(self.best) - 1
            self.best.append(np.maximum(last, np.r_[last[step:], last[:step]]))

    def maxima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The greatest impact in each stretch of postings, 0 in an empty one."""
        size = high - low
        level = np.frexp(np.maximum(size, 1))[1] - 1
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero((level == k) & (size > 0))
            out[at] = np.maximum(self.best[k][low[at]], self.best[k][high[at] - (1 << k)])
        return out

    def search(self, wanted: np.ndarray, k: int, best: list[tuple[int, int]]) -> None:
        """Put the best (score, -doc_id) of this piece into the heap ``best`` of at most ``k``."""
        base = wanted * self.docs
        turn, queue = 0, []

        def put(a: int, b: int, low: np.ndarray, high: np.ndarray) -> None:
            nonlocal turn
            some = high > low
            if some.all():
                own = base
            else:
                low, high, own = low[some], high[some], None
            if len(low):
                top = self.maxima(low, high)
                turn += 1
                heapq.heappush(queue, (-int(top.sum()), turn, a, b, low, high, top, base[some] if own is None else own))

        def keep(score: int, row: int) -> None:
            hit = (score, -int(self.ids[row]))
            if score > 0 and len(best) < k:
                heapq.heappush(best, hit)
            elif score > 0 and hit > best[0]:
                heapq.heapreplace(best, hit)

        low, high = self.start[wanted], self.start[wanted + 1]
        put(0, self.docs, low, high)
        while queue:
            bound, _, a, b, low, high, top, base = heapq.heappop(queue)
            if len(best) == k and -bound < best[0][0]:
                return
            if int((high - low).sum()) <= LEAF:
                at = np.repeat(low - np.r_[0, np.cumsum(high - low)[:-1]], high - low)
                at += np.arange(len(at))
                score = np.zeros(b - a, np.int64)
                np.add.at(score, self.row[at] - a, self.impact[at])
                least = best[0][0] if len(best) == k else 1
                good = np.flatnonzero(score >= least)
                for r in good[np.lexsort((self.ids[good + a], -score[good]))[:k]].tolist():
                    keep(int(score[r]), r + a)
                continue
            lead = int(np.argmax(top))
            row = int(self.row[low[lead] + np.argmax(self.impact[low[lead] : high[lead]])])
            mid = np.searchsorted(self.key, base + row)
            found = (mid < high) & (self.key[np.minimum(mid, len(self.key) - 1)] == base + row)
            keep(int(self.impact[mid[found]].sum()), row)
            put(a, row, low, mid)
            put(row + 1, b, mid + found, high)


def _answers(pieces: DataFrame, items, weight: np.ndarray, n: int, length: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): at most ``k`` rows of each item and task."""
    weights = pieces.sparkSession.sparkContext.broadcast(weight)  # as long as the block's vocabulary

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, _, item_terms = items.value
        best: list[list[tuple[int, int]]] = [[] for _ in item_ids]
        for batch in batches:
            for cells in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                ids, missing, sizes, term, row, times = (np.frombuffer(c, t) for c, t in zip(cells, (np.int64, bool, np.int64, np.int32, np.int32, np.int32), strict=True))
                here = ~missing[row]
                piece = Piece(ids, sizes, *(x[here].astype(np.int64) for x in (term, row, times)), weights.value, n, length)
                for wanted, found in zip(item_terms, best, strict=True):
                    piece.search(wanted, k, found)
        hits = [(item, -d, s) for item, found in zip(item_ids, best, strict=True) for s, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in hits], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    packed = pieces.select("ids", "missing", "sizes", "terms", "rows", "times")
    return packed.mapInArrow(ask, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, scores above 0 only.

    NULL and empty texts have no terms. Rows of one item_id are one item with the terms of
    all of them; NULL is an item id like any other. Each row of ``docs`` is a document:
    repeated ones are listed as often, those without an id count towards N, L and df but
    are not listed. Equal scores go by ascending doc_id. Empty tables give no rows. Other
    columns are ignored. Scores are exact while ``90 * terms * N`` stays below 2**63.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // ITEMS) or 1
    found = []
    for turn in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == turn).collect()  # about ITEMS bytes
        if not rows:
            continue
        block = read_items([tuple(r) for r in rows])
        shared = spark.sparkContext.broadcast(tuple(block))
        pieces = cut(index(docs, shared))
        n, length = pieces.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        weight = np.zeros(len(block.vocabulary), np.int64)
        for r in frequencies(pieces).collect():  # as long as the block's vocabulary
            weight[r.term] = math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1)))
        found.append(_answers(pieces, shared, weight, n, length, k))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc("doc_id")]
    # a first cut in salted groups: an item gets k rows of every task
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(width(spark)))
    few = union(found).withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    placed = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return placed.select("item_id", "rank", "doc_id", "score")


def op11(spark, sf_dir) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), sized AS (SELECT row_no, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized),
tf AS (SELECT row_no, doc_id, n, term, count(*) AS tf FROM (SELECT row_no, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
), impact AS (
  SELECT row_no, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l)))) AS points
  FROM tf JOIN weight USING (term), whole WHERE doc_id IS NOT NULL
), scored AS (
  SELECT item_id, row_no, doc_id, CAST(sum(points) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY item_id, row_no, doc_id
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
