"""Token counts by section (operator 6).

A document is encoded once, as a whole. Its sections are its paragraphs (stretches between
line ends; the line end belongs to the section before it). Token spans, in characters, are
interval-joined to section spans: both are in text order, so one merge finds the section
in which each token starts.

Rule for a token across a border: it counts for the section that holds its first
character. A token that starts inside a character counts where that character is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import _public, encoder, read_ranks
from millrace.llm.shared import table


def characters(data: np.ndarray) -> np.ndarray:
    """For each byte of a text, how many characters have begun up to it."""
    return np.cumsum((data & 0xC0) != 0x80)


def sections(data: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """The first character of each section."""
    ends = np.flatnonzero(data == 10)
    return np.r_[0, begun[ends[ends + 1 < len(data)]]].astype(np.int64)


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, section, first_char, n_chars, n_tokens, n_crossing) for every section of every row.

    ``n_crossing`` of a section's tokens reach into a later one. NULL or empty text is one
    section without characters or tokens. Other columns are ignored.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary.value, pattern)
        size = np.zeros(1 + max(map(int, e.vocabulary)), np.int64)
        for i, b in e.vocabulary.items():
            size[int(i)] = len(b)
        names = ["doc_id", "section", "first_char", "n_chars", "n_tokens", "n_crossing"]
        for batch in batches:
            rows, parts = [], []
            for row, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                data = np.frombuffer(text.encode(), np.uint8)
                begun = characters(data)
                first = sections(data, begun)
                ends = np.cumsum(size[np.fromstring(e.encode(text), np.int64, sep=" ")])
                tokens = begun[np.r_[0, ends[:-1]]] - 1 if len(ends) else ends
                last = np.r_[tokens[1:], len(text)] - 1 if len(tokens) else tokens
                home = np.searchsorted(first, tokens, side="right") - 1
                crossing = np.searchsorted(first, np.maximum(last, tokens), side="right") - 1 > home
                rows += [row] * len(first)
                parts.append(
                    np.stack([
                        np.arange(len(first)), first, np.diff(np.r_[first, len(text)]),
                        np.bincount(home, minlength=len(first)), np.bincount(home[crossing], minlength=len(first)),
                    ])
                )
            if parts:
                table = np.concatenate(parts, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c) for c in table)], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, section long, first_char long, n_chars long, n_tokens long, n_crossing long")


def op6(spark, sf_dir) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), *_public())
