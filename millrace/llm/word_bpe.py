"""BPE with word ends, by forced-boundary splitting (operator 13).

A byte pair that stands inside no vocabulary token can never be covered by one: whatever
the merges do, a token ends between its two bytes. Those pairs are marked once, in a table
of 256 x 256. Each word is cut wherever a marked pair stands, the fragments are merged on
their own, and their tokens are concatenated. Only the last fragment of a word carries the
word end. Fragments and words recur, so both are remembered.

What stands before the merges follows the tokenizer file: added tokens are found in the
text as it is, the stretches between them are brought to NFC and lower case and cut into
words. White space is no part of any word. Characters that this Python's Unicode tables do
not know are left to the library's own normaliser and word splitter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import table

#: Remembered words and fragments; when full, they are forgotten and made again.
WORDS = 1 << 19
#: A longer word or fragment is not remembered.
REMEMBERED = 64
#: More than any rank.
NEVER = 1 << 60

# The word pattern of the tokenizer file, and the same over ASCII.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable Latin-1 for itself, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordBpe:
    """Encodes and decodes by the text of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, added = spec["model"], spec["added_tokens"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError("a tokenizer file of another kind")
        self.file, self.library = text, None
        self.end = model["end_of_word_suffix"]
        letters = byte_letters()
        self.letter = {b: c for c, b in letters.items()}
        self.vocabulary: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocabulary.items()} | {a["id"]: a["content"] for a in added}
        self.number = {i: str(i) for i in self.token}
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        # by the two tokens: the rank, and below it the token they become
        self.merges = {self.vocabulary[a] << 20 | self.vocabulary[b]: rank << 20 | self.vocabulary[a + b] for rank, (a, b) in enumerate(pairs)}
        self.first = [[self.vocabulary[self.letter[b] + end] for b in range(256)] for end in ("", self.end)]
        self.added = {a["content"]: a["id"] for a in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        inside = np.zeros((256, 256), bool)
        for t in self.vocabulary:
            data = [letters[c] for c in t.removesuffix(self.end) if c in letters]
            inside[data[:-1], data[1:]] = True
        self.forced = (~inside).tobytes()  # 1 at 256 * left + right
        self.seen: set[str] = set()  # characters that this Python's Unicode tables know
        self.words = regex.compile(WORD_PATTERN).findall
        self.ascii_words = re.compile(ASCII_PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[tuple[bytes, bool], tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        """The words of a stretch without added tokens."""
        if text.isascii():
            return self.ascii_words(text.lower())
        if fresh := set(text) - self.seen:
            if any(unicodedata.category(c) == "Cn" for c in fresh):
                return self._library_words(text)
            self.seen |= fresh
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # letter by letter: a sigma that ends a word is lowered as any other
        return self.words(text.replace("Σ", "σ").lower())

    def _library_words(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.file)
        letters = byte_letters()
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(letters[c] for c in part).decode() for part, _ in parts]

    def cuts(self, data: bytes) -> list[int]:
        """The places in ``data`` at which a token must end."""
        forced = self.forced
        return [k for k, (a, b) in enumerate(pairwise(data), 1) if forced[a << 8 | b]]

    def word(self, word: str) -> tuple[int, ...]:
        """The tokens of one word."""
        data = word.encode()
        edges = [0, *self.cuts(data), len(data)]
        ids = tuple(chain.from_iterable([self.fragment(data[a:b], b == len(data)) for a, b in pairwise(edges)]))
        if len(data) <= REMEMBERED:
            if len(self.known) >= WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def fragment(self, data: bytes, last: bool) -> tuple[int, ...]:
        ids = self.fragments.get((data, last))
        if ids is None:
            ids = self._merge(data, last)
            if len(data) <= REMEMBERED:
                if len(self.fragments) >= WORDS:
                    self.fragments.clear()
                self.fragments[data, last] = ids
        return ids

    def _merge(self, data: bytes, last: bool) -> tuple[int, ...]:
        """Merge by rank, the leftmost first among equals."""
        single, closing = self.first
        ids = [single[b] for b in data]
        if last:
            ids[-1] = closing[data[-1]]
        if len(ids) > REMEMBERED:
            return self._merge_long(ids)
        get = self.merges.get
        ranks = [get(a << 20 | b, NEVER) for a, b in pairwise(ids)]
        while ranks and (best := min(ranks)) < NEVER:
            at = ranks.index(best)
            ids[at : at + 2] = [best & 0xFFFFF]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | ids[at], NEVER)
            if at < len(ranks):
                ranks[at] = get(ids[at] << 20 | ids[at + 1], NEVER)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same merges in n log n steps: a heap of those that may come next."""
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(rank, k, p) for k, p in enumerate(a << 20 | b for a, b in pairwise(ids)) if (rank := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at, pair = heapq.heappop(heap)
            to = after[at]
            if to >= n or ids[at] << 20 | ids[to] != pair:
                continue  # one of the two has been merged since
            ids[at], ids[to] = rank & 0xFFFFF, -1
            after[at] = to = after[to]
            if to < n:
                before[to] = at
                if (rank := get(p := ids[at] << 20 | ids[to])) is not None:
                    heapq.heappush(heap, (rank, at, p))
            if (left := before[at]) >= 0 and (rank := get(p := ids[left] << 20 | ids[at])) is not None:
                heapq.heappush(heap, (rank, left, p))
        return tuple(i for i in ids if i >= 0)

    def encode(self, text: str) -> list[int]:
        if self.specials is None or not self.specials.search(text):
            return self._stretch(text)
        out: list[int] = []
        for part in self.specials.split(text):
            out += [self.added[part]] if part in self.added else self._stretch(part)
        return out

    def _stretch(self, text: str) -> list[int]:
        get, make = self.known.get, self.word
        return [*chain.from_iterable([get(w) or make(w) for w in self.split(text)])]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens are joined by blanks."""
        return " ".join([*map(self.token.__getitem__, ids)])


_ENCODERS: dict[int, WordBpe] = {}


def encoder(text: str) -> WordBpe:
    """One encoder for each tokenizer file and Python worker."""
    if hash(text) not in _ENCODERS:
        _ENCODERS[hash(text)] = WordBpe(text)
    return _ENCODERS[hash(text)]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``.

    NULL text counts as empty: no tokens, and the hash of nothing. The strings of added
    tokens are those tokens, as in the library. Repeated rows come back as often, rows
    without an id with NULL; an empty table gives an empty one. Other columns are ignored.
    A word without forced cuts is one fragment, however long, and takes n log n steps.
    """
    with open(path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())  # one tokenizer file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(spec.value)
        number = e.number.__getitem__
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for text in batch.column(1):
                ids = e.encode(text.as_py() or "")
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join([*map(number, ids)]).encode()).hexdigest())
                text_hash.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
