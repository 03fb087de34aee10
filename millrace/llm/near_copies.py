"""N-gram Jaccard join with a token-group matrix (operator 9).

Two documents link when their sets of 5-word shingles have a Jaccard similarity of at
least ``percent`` hundredths. Every link between different texts is found; what comes back
is one row per document with the smallest id reachable over links.

1. Every document becomes a set of hashed shingles, named by a hash of the set, so copies
   are one set from here on.
2. Each shingle is sent once to a task that tells whether another set has it too, and
   answers one row to each bucket of sets. A set of which fewer than ``percent`` hundredths
   are shared can have no link and leaves.
3. Similar sets are partitioned into groups: three times, sets with the same least shingle
   under another hash are compared to one of them, the centre. Connected sets form a group.
   Sets that are still alone are grouped by their least shingle.
4. The matrix has a row for each (shingle, group). A set asks it with the shingles that
   any partner must meet (all but the most frequent ``percent`` hundredths less one) and
   gets the groups it might link with. A pair of groups is judged from its smaller side.
5. Groups come in slices of bounded size, each with the union of its shingles, and asking
   sets in blocks. A slice is opened to a set only if its union holds enough of the set;
   then the set is compared with all its members at once.

Hashes are 64 bits wide; equal hashes count as equal shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textbytes as tb
from millrace.llm.shared import components, cut, table, union, width

#: Shingles of a group's slice, about; a larger set is a slice by itself.
SLICE = 1 << 14
#: Sets that ask about a class at a time, about.
BLOCK = 64


def _set_names(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set names, set sizes, distinct shingles, their rows) of the texts in ``data``."""
    data = tb.lower(data)
    w = tb.words(data, offsets)
    token, row = tb.shingles(tb.word_hashes(data, w), w, size)
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    token, row = token[new], row[new]
    n = np.bincount(row, minlength=len(offsets) - 1)
    name = np.zeros(len(offsets) - 1, np.uint64)
    np.add.at(name, row, tb.mix(token + np.uint64(1)))
    return tb.mix(name + n.astype(np.uint64)), n, token, row


def _pieces(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of a sorted array."""
    if len(key):
        edges = np.flatnonzero(np.diff(key)) + 1
        for a, b in zip(np.r_[0, edges], np.r_[edges, len(key)], strict=True):
            yield int(key[a]), slice(a, b)


def shingle_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_id) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for a, b, data, offsets in tb.blocks(batch.column(1)):
                name, n, _, _ = _set_names(data, offsets, size)
                ids = batch.column(0).slice(a, b - a)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(name.view(np.int64))], ["doc_id", "n_shingles", "set_id"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_id long")


_PACKED = "p int, sets binary, sizes binary, counts binary, tokens binary"


def _shared_tokens(docs: DataFrame, size: int, ways: int) -> DataFrame:
    """(bucket, sets, sizes, counts, tokens): the shingles of a bucket's sets that another set has too, over several rows.

    Sets are dealt into ``ways`` buckets by name. Whoever counts a part of the shingles
    answers one row to each bucket, however many sets it has.

    A block of documents sends each shingle once. Those that several of its own sets have
    need no answer: they go on with a part number of ``ways`` or more, so a shingle that
    every document has is at most one entry a block where shingles are counted.
    """

    def packed(key: np.ndarray, of: np.ndarray, n: np.ndarray, token: np.ndarray, name: str) -> pa.RecordBatch:
        """A row for each key, from rows sorted by key and set: each set once, with the number of its shingles."""
        run = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])]) if len(key) else np.empty(0, np.int64)
        counts = np.diff(np.r_[run, len(key)]).astype(np.int32)
        keys, start = np.unique(key, return_index=True)
        ends = np.r_[start[1:], len(key)] if len(key) else start
        lo, hi = np.searchsorted(run, start), np.searchsorted(run, ends)
        columns = [
            pa.array(keys.astype(np.int32)),
            pa.array([of[run[a:b]].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
            pa.array([n[run[a:b]].astype(np.int32).tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
            pa.array([counts[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
            pa.array([token[a:b].tobytes() for a, b in zip(start, ends, strict=True)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, [name, "sets", "sizes", "counts", "tokens"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for _, _, data, offsets in tb.blocks(batch.column(0)):
                name, n, token, row = _set_names(data, offsets, size)
                _, once = np.unique(name, return_index=True)
                keep = np.zeros(len(name), bool)
                keep[once] = True
                token, row = token[keep[row]], row[keep[row]]
                order = np.argsort(token, kind="stable")
                token, row = token[order], row[order]
                starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
                times = np.diff(np.r_[starts, len(token)])
                many = np.repeat(times > 1, times)
                # own entries, a mark for what several have, and the members of the latter
                part = ((token >> np.uint64(40)) % np.uint64(ways)).astype(np.int64)
                mark = starts[times > 1]
                p = np.r_[part[~many], part[mark], ways + (name[row[many]] % np.uint64(ways)).astype(np.int64)]
                of = np.r_[name[row[~many]], np.zeros(len(mark), np.uint64), name[row[many]]]
                sizes = np.r_[n[row[~many]], np.zeros(len(mark), np.int64), n[row[many]]]
                token = np.r_[token[~many], token[mark], token[many]]
                order = np.lexsort((token, of, p))
                yield packed(p[order], of[order], sizes[order], token[order], "p")

    def answer(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        sets, sizes, counts, tokens = (
            np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("sets", np.uint64), ("sizes", np.int32), ("counts", np.int32), ("tokens", np.uint64))
        )
        of, n = np.repeat(sets, counts), np.repeat(sizes, counts)
        if key[0].as_py() < ways:
            order = np.lexsort((of, tokens))
            tokens, of, n = tokens[order], of[order], n[order]
            # another entry of the same shingle that is of another set, or a mark
            same = tokens[1:] == tokens[:-1]
            other = same & ((of[1:] != of[:-1]) | (of[1:] == 0))
            first = np.flatnonzero(np.r_[True, ~same]) if len(tokens) else np.empty(0, np.int64)
            lengths = np.diff(np.r_[first, len(tokens)])
            shared = np.repeat(np.logical_or.reduceat(np.r_[other, False], first) if len(first) else np.empty(0, bool), lengths)
            # the last entry of a run compares with the next run only in `same`, which is false there
            keep = shared & (of != 0)
            keep[1:] &= ~(same & (of[1:] == of[:-1]))
            tokens, of, n = tokens[keep], of[keep], n[keep]
        bucket = (of % np.uint64(ways)).astype(np.int64)
        order = np.lexsort((tokens, of, bucket))
        return pa.Table.from_batches([packed(bucket[order], of[order], n[order], tokens[order], "bucket")])

    sent = docs.select(F.col("text").cast("string")).mapInArrow(send, _PACKED)
    return sent.groupBy("p").applyInArrow(answer, _PACKED.replace("p int", "bucket int"))


def _similar(x: np.ndarray, nx: int, y: np.ndarray, ny: int, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (nx + ny - common)


def _tokens(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row after the other, so that the shingles of a single one are in memory twice."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _candidates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(set_id, n, tokens, least): sets that share enough shingles with others to have a link."""

    def gather(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        sets, sizes, counts, tokens = (
            np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("sets", np.uint64), ("sizes", np.int32), ("counts", np.int32), ("tokens", np.uint64))
        )
        of, n = np.repeat(sets, counts), np.repeat(sizes, counts)
        order = np.lexsort((tokens, of))
        of, n, tokens = of[order], n[order], tokens[order]
        # a set that several blocks hold comes from each of them
        new = np.r_[True, (of[1:] != of[:-1]) | (tokens[1:] != tokens[:-1])] if len(of) else np.empty(0, bool)
        of, n, tokens = of[new], n[new].astype(np.int64), tokens[new]
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
        ends = np.r_[start[1:], len(of)] if len(of) else start
        enough = 100 * (ends - start) >= percent * n[start]
        start, ends = start[enough], ends[enough]
        return pa.table(
            {
                "set_id": pa.array(of[start].view(np.int64)),
                "n": pa.array(n[start]),
                "tokens": pa.array([tokens[a:b].tobytes() for a, b in zip(start, ends, strict=True)], pa.binary()),
                "least": pa.array(tokens[start].view(np.int64)),
            }
        )

    shared = _shared_tokens(docs, size, width(docs.sparkSession))
    return cut(shared.groupBy("bucket").applyInArrow(gather, "set_id long, n long, tokens binary, least long"))


def _centre_links(sets: DataFrame, turn: int, percent: int) -> DataFrame:
    """Links (a, b) of sets to the centre of those with the same least shingle in this turn."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        salt = tb.mix(np.array([turn + 1], np.uint64))[0]
        for batch in batches:
            key = [int(tb.mix(_tokens(b) ^ salt).min().view(np.int64)) for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.int64())], ["set_id", "n", "tokens", "key"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (r["set_id"], r["c"])
                for r in _rows(batch)
                if _similar(_tokens(r["tokens"]), r["n"], _tokens(r["c_tokens"]), r["c_n"], percent)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    keyed = sets.select("set_id", "n", "tokens").mapInArrow(least, "set_id long, n long, tokens binary, key long")
    centre = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("set_id").alias("c")).where("members > 1").select("key", "c")
    centre = centre.join(sets.select(F.col("set_id").alias("c"), F.col("n").alias("c_n"), F.col("tokens").alias("c_tokens")), "c")
    pairs = keyed.join(centre, "key").where("set_id <> c").select("set_id", "n", "tokens", "c", "c_n", "c_tokens")
    return pairs.mapInArrow(compare, "a long, b long")


def _matrix_links(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets of different groups, found by asking the token-group matrix."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, blobs, group = (batch.column(i) for i in range(4))
            tokens = [_tokens(b).view(np.int64) for b in blobs.to_pylist()]
            take = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64)), ids.take(pa.array(take)), n.take(pa.array(take)), group.take(pa.array(take))],
                ["token", "set_id", "n", "class"],
            )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each set, rarest first, the shingles beyond those a partner may lack."""
        for batch in batches:
            n, held = (batch.column(i).to_numpy() for i in (1, 3))
            flat = batch.column(4).flatten()
            token, df = flat.field(1).to_numpy(), flat.field(0).to_numpy()
            lengths = np.diff(batch.column(4).offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), lengths)
            order = np.lexsort((token, df, row))
            place = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            lead = held - (percent * n + 99) // 100 + 1
            keep = place < lead[row]
            row, token = row[keep], token[order][keep]
            yield pa.RecordBatch.from_arrays([pa.array(token), *(batch.column(i).take(pa.array(row)) for i in (0, 2))], ["token", "q", "q_class"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up: dict[int, int] = {}
            out = []

            def root(x: int, up=up) -> int:
                while up.setdefault(x, x) != x:
                    up[x] = x = up[up[x]]
                return x

            for r in _rows(batch):
                members = r["members"]
                sizes = np.array([m["n"] for m in members])
                parts = [_tokens(m["tokens"]) for m in members]
                token = np.concatenate(parts)
                owner = np.repeat(np.arange(len(parts)), [len(t) for t in parts])[order := np.argsort(token, kind="stable")]
                total, first = np.unique(token[order], return_index=True)  # the slice's union
                ends = np.r_[first[1:], len(token)]
                for q in r["asking"]:
                    tokens, n = _tokens(q["tokens"]), q["n"]
                    at = np.minimum(np.searchsorted(total, tokens), len(total) - 1)
                    at = at[total[at] == tokens]
                    if 100 * len(at) < percent * n:
                        continue
                    lengths = ends[at] - first[at]
                    flat = np.repeat(first[at] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
                    common = np.bincount(owner[flat], minlength=len(members))
                    for k in np.flatnonzero(100 * common >= percent * (n + sizes - common)):
                        x, y = root(q["root"]), root(members[k]["root"])
                        if x != y:  # else this batch has said so already
                            up[x] = y
                            out.append((q["set_id"], members[k]["set_id"]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    grouped = sets.join(groups, "set_id", "left").select("set_id", "n", "tokens", "least", F.coalesce("root", "set_id").alias("root"))
    members = grouped.groupBy("root").agg(F.count("*").alias("size"))
    # sets without a link so far are grouped by their least shingle
    grouped = grouped.join(members, "root").select(
        "set_id", "n", "tokens", "root", F.when(F.col("size") > 1, F.col("root")).otherwise(F.col("least")).alias("class"), (F.col("size") > 1).alias("linked")
    )
    grouped = cut(grouped.withColumn("class", F.xxhash64("class", "linked")))
    sizes = grouped.groupBy("class").agg(F.count("*").alias("size"), F.sum(F.octet_length("tokens") / 8).alias("held"))
    posts = grouped.select("set_id", "n", "tokens", "class").mapInArrow(unpack, "token long, set_id long, n long, class long")
    cells = posts.groupBy("token", "class").agg(F.count("*").alias("df")).join(sizes.select("class", "size"), "class")
    rows = cells.groupBy("token").agg(F.sum("df").alias("df"))
    matrix = cut(cells.select("token", "class", "size"))
    asks = (
        posts.join(rows, "token")
        .groupBy("set_id", "n", "class")
        .agg(F.count("*").alias("held"), F.collect_list(F.struct("df", "token")).alias("all"))
        .mapInArrow(ask, "token long, q long, q_class long")
        .join(sizes.select(F.col("class").alias("q_class"), F.col("size").alias("q_size")), "q_class")
    )
    # each pair of classes is asked about from its smaller side; a class of unlinked sets asks itself as well
    met = asks.join(matrix, "token").where("size > q_size OR (size = q_size AND class >= q_class)")
    met = met.select("q", "class").distinct().join(grouped.select(F.col("set_id").alias("q"), "n", "tokens", "root", F.col("class").alias("own"), "linked"), "q")
    met = cut(met.where("NOT linked OR class <> own").select("class", "q", "n", "tokens", "root"))
    counts = met.groupBy("class").agg(F.count("*").alias("asking"))
    blocks = (
        met.join(counts, "class")
        .groupBy("class", F.pmod(F.xxhash64("q"), F.ceil(F.col("asking") / BLOCK).cast("long")).alias("block"))
        .agg(F.collect_list(F.struct(F.col("q").alias("set_id"), "n", "tokens", "root")).alias("asking"))
        .select("class", "asking")
    )
    pages = F.ceil(F.col("held") / SLICE).cast("long")
    slices = (
        grouped.join(sizes.select("class", "held"), "class")
        .groupBy("class", F.pmod(F.xxhash64("set_id"), pages).alias("slice"))
        .agg(F.collect_list(F.struct("set_id", "n", "tokens", "root")).alias("members"))
        .select("class", "members")
    )
    return blocks.join(slices, "class").select("asking", "members").mapInArrow(compare, "a long, b long")


def jaccard_classes(docs: DataFrame, size: int = 5, percent: int = 75, turns: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    A text without words, or NULL, has an empty set and is its own component. Rows of one
    doc_id each count as a document. The component of documents without an id is NULL.
    Other columns are ignored.
    """
    own = cut(shingle_sets(docs, size))
    sets = _candidates(docs, size, percent)
    near = cut(union([_centre_links(sets, turn, percent) for turn in range(turns)]))
    groups = cut(components(near).withColumnRenamed("node", "set_id"))
    far = cut(_matrix_links(sets, groups, percent))
    if not far.isEmpty():
        groups = cut(components(near.union(far)).withColumnRenamed("node", "set_id"))
    rooted = own.join(groups, "set_id", "left")
    rooted = rooted.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "set_id")).alias("root"))
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")).where("members > 1")
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def op9(spark, sf_dir) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, with the columns it came with.

    Rows that agree in doc_id and text are one document. Texts without words are linked
    with nothing and stay.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("_row"), F.struct("*").alias("_all"))
    classes = jaccard_classes(rows.select(F.col("_row").alias("doc_id"), "_all.text"))
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select("_all.*")
