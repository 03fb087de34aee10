"""Quality rules: hashed n-gram log-likelihood ratio of each document (operator 1).

Words and word pairs are hashed into ``BUCKETS`` buckets. Two multinomials with add-one
smoothing are counted: the raw one over all documents, the target one over trusted
documents (labelled good and not toxic). A document's score is the mean over its n-grams of
log p_target - log p_raw. It passes if the score reaches one threshold, which is the same
for all: the ``quantile`` of scores of trusted documents that were not counted.

All trusted documents are used: in the order of their hashed ids every other one is counted,
the rest set the threshold. The raw counts, and all else, cover every document. Without
trusted documents only the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import textbytes as tb
from millrace.llm.shared import table
from millrace.plans.ordered import row_number, running_sum, with_measures
from millrace.session import written_table

BUCKETS = 1 << 16
QUANTILE = 0.002
#: Bits for hashed ids, which keep other texts out of a shuffle.
SLOTS = 1 << 25
_CHUNK = 1 << 11

_FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _grams(hashes: np.ndarray, w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word and every pair of neighbouring words of a text."""
    pair = w.text[1:] == w.text[:-1]
    two = tb.mix(hashes[:-1] * np.uint64(3) + tb.mix(hashes[1:]))[pair]
    bucket = np.r_[hashes, two] >> np.uint64(48)
    return bucket.astype(np.int64) % BUCKETS, np.r_[w.text, w.text[1:][pair]]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][offsets])


def _repeated(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which entries have an equal one in the same text."""
    order = np.lexsort((hashes, text))
    same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    out = np.zeros(len(hashes), bool)
    out[order] = np.r_[same, False] | np.r_[False, same]
    return out[: len(hashes)]


def _base(data: np.ndarray, offsets: np.ndarray, w: tb.Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    texts = len(offsets) - 1
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, w.start, 1)
    np.add.at(edge, w.end, -1)
    in_word = np.cumsum(edge[:-1]) > 0
    n = np.diff(w.first)

    # lines: from after a line end or text start to the next line end or text end
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.r_[offsets[:-1], breaks + 1])
    line_text = np.searchsorted(offsets, start, side="right") - 1
    line_text = np.minimum(line_text, texts - 1)
    line_end = np.searchsorted(breaks, start)
    end = np.where(line_end < len(breaks), np.r_[breaks, len(data)][line_end], len(data))
    end = np.minimum(end, offsets[line_text + 1])
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, line_text = start[has_word], end[has_word], line_text[has_word]
    line = tb.spans(tb.prefix_sums(data), start, end)
    order = np.lexsort((line, line_text))
    again = (line[order][1:] == line[order][:-1]) & (line_text[order][1:] == line_text[order][:-1])

    # words inside runs of three that the text has twice
    threes = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 2:
        whole = np.flatnonzero(w.text[2:] == w.text[:-2])
        h = tb.mix(hashes[whole] * np.uint64(3) + tb.mix(hashes[whole + 1] * np.uint64(5) + tb.mix(hashes[whole + 2])))
        found = whole[_repeated(h, w.text[whole])]
        np.add.at(threes, found, 1)
        np.add.at(threes, np.minimum(found + 3, len(hashes)), -1)
    covered = np.cumsum(threes[:-1]) > 0
    return {
        "n_words": n,
        "word_chars": _per_text(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_text[order][1:][again], minlength=texts),
        "n_repeat_words": np.bincount(w.text[covered], minlength=texts),
    }


def _scores(hashes: np.ndarray, w: tb.Words, ratio: np.ndarray, texts: int) -> np.ndarray:
    bucket, text = _grams(hashes, w)
    n = np.bincount(text, minlength=texts)
    return np.round(np.bincount(text, weights=ratio[bucket], minlength=texts) / np.maximum(n, 1), 9)


def _count(docs: DataFrame, counted: DataFrame) -> np.ndarray:
    """Counts per bucket: row 0 over all rows of ``docs``, row 1 over those of ``counted``, both (text)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            of = batch.column(0).to_numpy()
            for a, b, data, offsets in tb.blocks(batch.column(1)):
                w = tb.words(data, offsets)
                bucket, text = _grams(tb.word_hashes(data, w), w)
                counts += np.bincount(of[a:b][text] * BUCKETS + bucket, minlength=2 * BUCKETS).reshape(2, -1)
        parts = range(BUCKETS // _CHUNK)
        cells = [counts[:, k * _CHUNK : (k + 1) * _CHUNK].tobytes() for k in parts]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(cells, pa.binary())], ["chunk", "counts"])

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.int64) for b in group.column("counts").to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, counts binary"
    out = np.zeros((2, BUCKETS), np.int64)
    both = docs.select(F.lit(0).cast("long").alias("of"), "text").unionAll(counted.select(F.lit(1).cast("long"), "text"))
    # one row for each of a fixed number of chunks of buckets
    for row in both.mapInArrow(local, schema).groupBy("chunk").applyInArrow(add, schema).collect():
        out[:, row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["counts"], np.int64).reshape(2, -1)
    return out


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(text) of the rows of ``docs`` (doc_id, text) whose id is among ``ids`` (doc_id, each once).

    Where the ids are too many to broadcast, the join shuffles texts. Bitmaps of hashed
    ids, of a size that does not grow, first drop most rows that would find no id.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)) + 1
    at, bit = F.bitmap_bucket_number(slot).alias("__map"), F.bitmap_bit_position(slot)
    maps = ids.groupBy(at).agg(F.bitmap_construct_agg(bit).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(bit, F.lit(8)).cast("int"))) != 0
    likely = docs.withColumn("__map", at).join(F.broadcast(maps), "__map").where(hit).select("doc_id", "text")
    # not a semi-join, which Spark would put before the other
    return likely.join(ids.select("doc_id"), "doc_id").select("text")


def fit(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> tuple[np.ndarray, float] | None:
    """The log ratio of each bucket and the threshold; None without trusted documents."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    hashed = good.withColumn("__hash", F.xxhash64("doc_id"))
    placed = with_measures(hashed, [], ["__hash", "doc_id"], {"__no": row_number()})
    # a table of its own, whose size Spark knows when it picks the joins
    halves = written_table(placed.select("doc_id", (F.col("__no") % 2 == 1).alias("counted")))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    raw, target = _count(docs, _texts_of(docs, halves.where("counted"))).astype(float)
    if not target.sum():
        return None
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for a, b, data, offsets in tb.blocks(batch.column(0)):
                w = tb.words(data, offsets)
                scores = _scores(tb.word_hashes(data, w), w, ratio, b - a)
                yield pa.RecordBatch.from_arrays([pa.array(scores[np.diff(w.first) >= 50])], ["llr"])

    held = _texts_of(docs, halves.where("NOT counted"))
    at = _least_reaching(held.mapInArrow(score, "llr double"), "llr", quantile)
    return None if at is None else (ratio, at)


def _least_reaching(df: DataFrame, column: str, share: float) -> float | None:
    """The least value up to which at least this share of the rows lie; None without rows."""
    values = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    placed = written_table(with_measures(values, [], [column], {"__upto": running_sum("__n")}))
    total = placed.agg(F.max("__upto")).first()[0]
    return None if total is None else placed.where(F.col("__upto") >= F.lit(total * share)).agg(F.min(column)).first()[0]


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Rows (row, q): each row of ``docs`` whole, as a struct, and its base counts and verdict.

    NULL text counts as empty and fails the base rules. Repeated rows are judged alike.
    Columns of any name beside doc_id and text are carried in ``row``.
    """
    model = fit(docs, labels, quantile)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            text = batch.column(0).field("text")
            for a, b, data, offsets in tb.blocks(text):
                w = tb.words(data, offsets)
                hashes = tb.word_hashes(data, w)
                q = _base(data, offsets, w, hashes)
                q["base_failed"] = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
                q["llr"] = _scores(hashes, w, model[0], b - a) if model else np.zeros(b - a)
                q["kept"] = ~q["base_failed"] & (q["llr"] >= (model[1] if model else 0))
                struct = pa.StructArray.from_arrays([pa.array(v) for v in q.values()], list(q))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), struct], ["row", "q"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = T.StructType([T.StructField("row", T.StructType(docs.schema.fields)), T.StructField("q", T.StructType.fromDDL(_FEATURES))])
    return rows.mapInArrow(judge, schema)


def op1(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, table(spark, sf_dir, "labels")).select("row.doc_id", "q.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    return quality(docs, table(spark, sf_dir, "labels")).where("q.kept").select("row.*")
