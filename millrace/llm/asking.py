"""Texts in numbered blocks that ask which of their names occur elsewhere too.

A block is a stretch of texts of some 2 MB, packed in one row. It sends its names once,
cut into parts; whoever counts a part sends one row of bits back to each block. So the
rows sent and answered go with blocks and parts, never with texts, and a name that every
text has is one entry a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textbytes as tb
from millrace.llm.shared import cut

BLOCKS = "block long, keys array<long>, sizes binary, packed binary"
ASKED = "p int, block long, owners binary, counts binary, names binary"
_ANSWER = "block long, p int, shared binary, leads binary"

#: Names of 4, 8 and 16 bytes.
SHORT, LONG, WIDE = np.dtype(np.uint32), np.dtype(np.uint64), np.dtype([("a", np.uint64), ("b", np.uint64)])


def packed_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (key long, text) as blocks, written once, so that their numbers stay what they are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, turn = zstandard.ZstdCompressor(level=3), 0
        for batch in batches:
            for a, b, data, offsets in tb.blocks(batch.column(2)):
                cells = [
                    pa.array([batch.column(0)[0].as_py() << 32 | turn]),
                    pa.array([batch.column(1).slice(a, b - a).to_pylist()], pa.list_(pa.int64())),
                    pa.array([np.diff(offsets).astype(np.int32).tobytes()], pa.binary()),
                    pa.array([squeeze.compress(data.tobytes())], pa.binary()),
                ]
                turn += 1
                yield pa.RecordBatch.from_arrays(cells, ["block", "keys", "sizes", "packed"])

    placed = rows.select(F.spark_partition_id().alias("part"), F.col("key").cast("long"), F.col("text").cast("string"))
    return cut(placed.mapInArrow(pack, BLOCKS))


def opened(sizes: bytes, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a block and where its texts begin."""
    offsets = np.r_[0, np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64)]
    data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(offsets[-1])) if offsets[-1] else b""
    return np.frombuffer(data, np.uint8), offsets


def part_of(name: np.ndarray, ways: int) -> np.ndarray:
    """The part that counts a 64-bit name; the low 32 bits tell names of a part apart."""
    return ((name >> np.uint64(32)) % np.uint64(ways)).astype(np.int64)


def order_of(part: np.ndarray, *names: np.ndarray) -> np.ndarray:
    """The order in which a block lists what it asks, and so the order of the bits it gets."""
    return np.lexsort((*names, part))


def asked(block: int, part: np.ndarray, names: np.ndarray, owners: np.ndarray | None = None) -> pa.RecordBatch:
    """What a block sends: names sorted by part, one row for each part.

    With ``owners`` a name counts as shared if another owner has it, whichever the block;
    owner 0 stands for several. Without, if another block has it.
    """
    parts, start = np.unique(part, return_index=True)
    ends = np.r_[start[1:], len(part)]
    runs = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (owners[1:] != owners[:-1])]) if owners is not None and len(part) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[runs, len(part)]).astype(np.int32)
    lo, hi = np.searchsorted(runs, start), np.searchsorted(runs, ends)
    whole = owners if owners is not None else np.zeros(0, np.uint64)
    columns = [
        pa.array(parts.astype(np.int32)),
        pa.array(np.full(len(parts), block, np.int64)),
        pa.array([whole[runs[a:b]].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
        pa.array([counts[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
        pa.array([names[a:b].tobytes() for a, b in zip(start, ends, strict=True)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["p", "block", "owners", "counts", "names"])


def answers(sent: DataFrame, kinds: list[tuple[int, np.dtype]]) -> DataFrame:
    """(block, told): for each block its answers, an array of (p, shared, leads).

    ``shared`` has a bit for each name sent: whether it occurs elsewhere. ``leads`` tells
    the first of its occurrences. ``kinds`` lists (first part, kind of name), by part.
    """

    def answer(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        kind = [k for first, k in kinds if key[0].as_py() >= first][-1]
        blobs = group.column("names").to_pylist()
        names = np.frombuffer(b"".join(blobs), kind)
        sizes = np.array([len(b) // kind.itemsize for b in blobs])
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.int32)
        if len(counts):
            of = np.repeat(np.frombuffer(b"".join(group.column("owners").to_pylist()), np.uint64), counts)
        else:
            of = np.repeat(np.arange(1, len(blobs) + 1, dtype=np.uint64), sizes)
        order = np.lexsort((of, names) if kind.names is None else (of, names["b"], names["a"]))
        names, of = names[order], of[order]
        first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        last = np.r_[first[1:], len(names)] - 1
        shared, leads = np.zeros(len(names), bool), np.zeros(len(names), bool)
        shared[order] = np.repeat(of[first] != of[last], last - first + 1)
        leads[order[first]] = True
        ends = np.cumsum(sizes)
        bits = [[np.packbits(x[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)] for x in (shared, leads)]
        return pa.table({"block": group.column("block"), "p": group.column("p"), "shared": pa.array(bits[0], pa.binary()), "leads": pa.array(bits[1], pa.binary())})

    told = cut(sent.groupBy("p").applyInArrow(answer, _ANSWER))
    return told.groupBy("block").agg(F.collect_list(F.struct("p", "shared", "leads")).alias("told"))


def heard(told: list[dict], part: np.ndarray, field: str = "shared") -> np.ndarray:
    """The bits of a block's names, which are sorted by part."""
    out = np.zeros(len(part), bool)
    if not len(part):
        return out
    bits = {t["p"]: t[field] for t in told or []}
    parts, start = np.unique(part, return_index=True)
    for p, a, b in zip(parts.tolist(), start, np.r_[start[1:], len(part)], strict=True):
        out[a:b] = np.unpackbits(np.frombuffer(bits[p], np.uint8), count=b - a)
    return out
