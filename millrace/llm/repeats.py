"""Removal of repeated stretches of bytes (operator 5).

Every byte that is inside a string of ``length`` bytes which starts anywhere else as well
goes; strings are judged on the input and overlaps count.

This is not prefix doubling over sorted rank pairs: a pair for every position and round
would shuffle many times the input (the README has the figures). What is kept of it is
that positions carry names of what follows them, and only those whose name is not unique
go on to the next length. Names are hashes of the bytes, and only anchors are asked about
at half the length:

1. Half the length: of each stretch of ``length`` bytes, the position whose half-length
   name is least is its anchor. If a stretch repeats in another text, so does its anchor;
   stretches with a unique anchor are out.
2. The whole length: names of the stretches that are left are counted the same way.
3. Each text loses the bytes that its repeated names cover.

Texts stand in blocks, which ask and are answered as a whole. A name that several texts of
a block have is known there, and only a mark goes on, so a passage that all documents share
gathers nowhere. Texts are counted as wholes as well: one that has a copy goes altogether,
and only the first block that holds it asks on its behalf. Whole texts are told apart by
128 bits, stretches by 64 bits and the part they are counted in, which comes from another
hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import asking
from millrace.llm import textbytes as tb
from millrace.llm.shared import table, width


class Block:
    """Some texts one after the other, and names of their positions."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        half = length // 2
        size = len(data)
        self.length, self.offsets = length, offsets
        self.sums = tb.prefix_sums(data)
        at = np.arange(max(size - half + 1, 0))
        names = tb.spans(self.sums, at, at + half)
        wide = length - half + 1
        starts = max(size - length + 1, 0)
        self.row = np.searchsorted(offsets, np.arange(starts), side="right") - 1
        self.whole = np.arange(starts) + length <= offsets[self.row + 1]
        self.least = np.where(self.whole, _slide(names, wide, np.minimum)[:starts], np.uint64(0))
        # a position is an anchor if a stretch over it has its name as the least
        padded = np.r_[np.zeros(wide - 1, np.uint64), self.least, np.zeros(wide - 1, np.uint64)]
        anchor = np.flatnonzero((_slide(padded, wide, np.maximum)[: len(names)] == names) & (names > 0)) if starts else np.empty(0, np.int64)
        row = np.searchsorted(offsets, anchor, side="right") - 1
        self.anchors = _distinct(row, names[anchor])
        self.texts = [data[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
        self.key = np.array([xxhash.xxh3_64_intdigest(t) or 1 for t in self.texts], np.uint64)
        wide = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in self.texts), asking.WIDE)
        _, first, self.same, times = np.unique(wide, return_index=True, return_inverse=True, return_counts=True)
        self.first = np.zeros(len(wide), bool)
        self.first[first] = True
        self.copied = (times > 1)[self.same]
        long_texts = first[np.diff(offsets)[first] >= length]
        self.wide, self.wide_row = wide[long_texts], long_texts

    def ask_anchors(self, ways: int) -> tuple[np.ndarray, ...]:
        """(name, row, owner, part) to ask about, then (name, row) of what several texts of the block have."""
        row, name, _ = self.anchors
        row, name = row[self.first[row]], name[self.first[row]]
        order = np.argsort(name, kind="stable")
        row, name = row[order], name[order]
        start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.empty(0, np.int64)
        times = np.diff(np.r_[start, len(name)])
        many = np.repeat(times > 1, times)
        mark = start[times > 1]
        ask, of = np.r_[name[~many], name[mark]], np.r_[row[~many], np.full(len(mark), -1)]
        owner = np.where(of >= 0, self.key[of], np.uint64(0)) if len(of) else np.empty(0, np.uint64)
        part = asking.part_of(ask, ways)
        order = asking.order_of(part, ask, owner)
        return ask[order], of[order], owner[order], part[order], name[many], row[many]

    def ask_texts(self, ways: int) -> tuple[np.ndarray, ...]:
        """(row, name, part) of the different texts of ``length`` bytes or more."""
        part = ways + asking.part_of(self.wide["a"], ways)
        order = asking.order_of(part, self.wide["b"], self.wide["a"])
        return self.wide_row[order], self.wide[order], part[order]

    def judge(self, told: list[dict], ways: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which rows have a copy; then starts and names of the stretches that may repeat.

        A text with copies takes part once, in the first of its blocks.
        """
        at, _, part = self.ask_texts(ways)
        copied, speaks = self.copied.copy(), self.first.copy()
        elsewhere = asking.heard(told, part)
        copied[at] |= elsewhere
        speaks[at] &= ~elsewhere | asking.heard(told, part, "leads")
        copied = _by_first(copied, self.first, self.same)
        name, row, _, part, known, known_row = self.ask_anchors(ways)
        hit = asking.heard(told, part) & (row >= 0)
        own_row, own_name, twice = self.anchors
        row, name = np.r_[row[hit], known_row, own_row[twice]], np.r_[name[hit], known, own_name[twice]]
        start, name = self.stretches(row[speaks[row]], name[speaks[row]])
        return copied, start, name

    def second(self, at: np.ndarray) -> np.ndarray:
        """Another hash of the stretches from ``at`` on, over four pieces of them."""
        out = np.zeros(len(at), np.uint64)
        cuts = np.linspace(0, self.length, 5).astype(np.int64)
        for k in range(4):
            out = tb.mix(out * np.uint64(0xD6E8FEB86659FD93) + (tb.spans(self.sums, at + cuts[k], at + cuts[k + 1]) ^ np.uint64(k + 1)))
        return out

    def stretches(self, row: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and names of the stretches whose anchor is among (row, name)."""
        starts = len(self.least)
        if not starts or not len(name):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        first = np.flatnonzero(np.r_[True, (self.least[1:] != self.least[:-1]) | (self.row[1:] != self.row[:-1])])
        hit = np.isin(_pair(self.row[first], self.least[first]), _pair(row, name))
        at = np.flatnonzero(np.repeat(hit, np.diff(np.r_[first, starts])) & self.whole)
        return at, tb.spans(self.sums, at, at + self.length)


def _slide(x: np.ndarray, wide: int, best: np.ufunc) -> np.ndarray:
    """The best of each ``wide`` neighbours."""
    step = 1
    while step * 2 <= wide:
        x = best(x[:-step], x[step:])
        step *= 2
    rest = wide - step
    return best(x[:-rest], x[rest:]) if rest else x


def _pair(row: np.ndarray, name: np.ndarray) -> np.ndarray:
    return tb.mix(name ^ tb.mix(row.astype(np.uint64) + np.uint64(1)))


def _distinct(row: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, name, whether more than once in its text), by row and name."""
    order = np.lexsort((name, row))
    row, name = row[order], name[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (name[1:] != name[:-1])]) if len(row) else np.empty(0, np.int64)
    return row[first], name[first], np.diff(np.r_[first, len(row)]) > 1


def _by_first(value: np.ndarray, first: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Each row's value is that of the first row with the same text."""
    of = np.zeros(int(same.max(initial=-1)) + 1, bool)
    of[same[first]] = value[first]
    return of[same]


def _asked_stretches(block: Block, start: np.ndarray, name: np.ndarray, ways: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, part) of the stretches that are asked about; for each start its number among those or -1: the block has it twice."""
    different, first, number, times = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    part = asking.part_of(block.second(start[first]), ways)
    order = asking.order_of(part, different)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return different[order], part[order], place[number], (times > 1)[number]


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs`` (doc_id, text).

    NULL text counts as empty. Repeated rows count as copies of each other. Texts of fewer
    than ``length`` bytes stay whole. An empty table gives an empty one. Other columns are
    ignored. A text longer than a block is a block by itself.
    """
    ways = width(docs.sparkSession)
    blocks = asking.packed_blocks(docs.select(F.col("doc_id").alias("key"), "text"))
    texts = blocks.select("block", "sizes", "packed")

    def cells(batch: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for number, sizes, packed in cells(batch):
                block = Block(*asking.opened(sizes, packed), length)
                name, _, owner, part, _, _ = block.ask_anchors(ways)
                if len(name):
                    yield asking.asked(number, part, name.astype(np.uint32), owner)
                _, name, part = block.ask_texts(ways)
                if len(name):
                    yield asking.asked(number, part, name)

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for number, sizes, packed, told in cells(batch):
                block = Block(*asking.opened(sizes, packed), length)
                _, start, name = block.judge(told, ways)
                name, part, _, _ = _asked_stretches(block, start, name, ways)
                if len(name):
                    yield asking.asked(number, part, name)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for keys, sizes, packed, told, told_wholes in cells(batch):
                data, offsets = asking.opened(sizes, packed)
                block = Block(data, offsets, length)
                copied, start, name = block.judge(told, ways)
                _, part, place, twice = _asked_stretches(block, start, name, ways)
                hit = start[twice | asking.heard(told_wholes, part)[place]]
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + length, -1)
                covered = np.cumsum(edge[:-1]) > 0
                out = []
                for k, key in enumerate(keys):
                    mine, own = data[offsets[k] : offsets[k + 1]], covered[offsets[k] : offsets[k + 1]]
                    if copied[k] and len(mine) >= length:
                        own = np.ones(len(mine), bool)
                    kept = mine[~own].tobytes()
                    spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(own[:1].sum())
                    out.append((key, len(mine), int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    first = asking.answers(texts.mapInArrow(halves, asking.ASKED), [(0, asking.SHORT), (ways, asking.WIDE)])
    asking_on = texts.join(first, "block").select("block", "sizes", "packed", "told")
    second = asking.answers(asking_on.mapInArrow(wholes, asking.ASKED), [(0, asking.LONG)]).withColumnRenamed("told", "told_wholes")
    known = blocks.join(first, "block", "left").join(second, "block", "left").select("keys", "sizes", "packed", "told", "told_wholes")
    return known.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op5(spark, sf_dir) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
