"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding (operator 3).

The merges are compiled into a transducer over bytes. It holds the ways to go on: for each
place where a token may still be open, the place in the token trie and the token before
it. Reading a byte extends the open tokens; of those that end here, the longest that may
follow its predecessor is the last token of the only encoding of the bytes so far. Sets of
ways become states when first met, in the first ``REACH`` bytes of a piece, which most
pieces share. Further on, a short piece asks for the last token only at the places it
needs, from its end backwards; a long one follows the ways. What all ways have in common
is settled; none reaches back further than the longest token, so tokens come out after
bounded lookahead. Two tokens may follow each other if no merge across their border comes
before the merges that make them.

Decoding joins the tokens' bytes and runs an incremental UTF-8 state machine, so text can
be had after any number of ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import table

#: Remembered pieces and states; when full, they are forgotten and made again.
PIECES, PARTS, STATES = 3 << 18, 1 << 18, 1 << 16
#: Remembered beginnings and endings of pieces; when full, they are forgotten and made again.
HEADS, TAILS = 1 << 16, 1 << 17
#: Bytes of a piece for which states are made, and bytes after which a long piece is settled.
REACH, SETTLE = 5, 512
#: Words decoded at a time.
BLOCK = 1 << 14
#: Bytes of a short piece, and of the stretch at its end whose tokens are remembered.
SHORT, TAIL = 64, 5


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class _State:
    __slots__ = ("ways", "next")

    def __init__(self, ways: tuple[tuple[int, int], ...]):
        self.ways = ways
        self.next: dict[int, tuple[_State, int]] = {}  # by byte: the state after it and the last token


class Transducer:
    """Encodes one piece of bytes at a time; equal to merging by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.depth: list[int] = [0]
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        for word, rank in ranks.items():
            at = 0
            for byte in word:
                to = self.trie[at].get(byte)
                if to is None:
                    to = self.trie[at][byte] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                    self.depth.append(self.depth[at] + 1)
                at = to
            self.token[at] = rank
        self.back: list[dict[int, int]] = [{}]  # the trie of the tokens read backwards
        self.back_token: list[int] = [-1]
        for word, rank in ranks.items():
            at = 0
            for byte in reversed(word):
                to = self.back[at].get(byte)
                if to is None:
                    to = self.back[at][byte] = len(self.back)
                    self.back.append({})
                    self.back_token.append(-1)
                at = to
            self.back_token[at] = rank
        self.fit: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.spines: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        self.tails: dict[bytes, tuple[tuple[tuple[int, int], ...], int | None]] = {}
        self.forget()

    def forget(self) -> None:
        for state in getattr(self, "states", {}).values():
            state.next.clear()  # states lead to each other; apart, they are freed at once
        # a way: (trie node, token before the open one); the last way is the one between tokens
        self.states: dict[tuple, _State] = {}
        self.start = _State(((0, -1),))
        # by a piece's first bytes: the state after them and the last token at each place
        self.heads: dict[bytes, tuple[_State, list[int]]] = {}
        self.tails.clear()

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``; None for a single byte."""
        if token in self.split:
            return self.split[token]
        data = self.bytes_of[token]
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            ranks = [self.ranks.get(a + b, token) for a, b in pairwise(parts)]
            best = min(range(len(ranks)), key=ranks.__getitem__)
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        self.split[token] = halves = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return halves

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one end of ``token`` while it is merged, each with the rank at which it is merged away."""
        key = (token, side)
        if key not in self.spines:
            out, until = [], 1 << 60
            while True:
                out.append((token, until))
                if (halves := self.halves(token)) is None:
                    break
                token, until = halves[side], token
            self.spines[key] = [(self.bytes_of[t], u) for t, u in out]
        return self.spines[key]

    def follows(self, left: int, right: int) -> bool:
        """Whether the two stay apart: no token across the border is merged first.

        Of equal ranks the leftmost merge comes first.
        """
        known = self.fit.get(left << 20 | right)
        if known is None:
            if len(self.fit) > 4 * PIECES:
                self.fit.clear()
            known = True
            for a, a_until in self.spine(left, 1):
                for b, b_until in self.spine(right, 0):
                    rank = self.ranks.get(a + b)
                    if rank is not None and rank < a_until and rank <= b_until:
                        known = False
                        break
                if not known:
                    break
            self.fit[left << 20 | right] = known
        return known

    def _read(self, ways: Iterable[tuple[int, int]], byte: int) -> tuple[list[tuple[int, int]], int]:
        """The ways after ``byte``, and the last token of what has been read."""
        trie, fit, on, last = self.trie, self.fit, [], -1
        for node, before in ways:  # the longest open token first
            to = trie[node].get(byte)
            if to is not None:
                if last < 0 and (found := self.token[to]) >= 0:
                    fits = before < 0 or fit.get(before << 20 | found)
                    if fits or (fits is None and self.follows(before, found)):
                        last = found
                if trie[to]:
                    on.append((to, before))
        on.append((0, last))
        return on, last

    def encode(self, piece: bytes) -> list[int]:
        n = len(piece)
        state, lasts = self.heads.get(piece[:REACH]) or self._head(piece[:REACH])
        if n <= REACH:
            return self._back(lasts, n)
        if n <= SHORT:
            lasts = lasts + [-1] * (n - REACH)
            self._last(piece, lasts, n)
            return self._back(lasts, n)
        lasts = lasts.copy()
        ways, out, read = state.ways, [], self._read
        for byte in piece[REACH:]:
            ways, last = read(ways, byte)
            lasts.append(last)
            if len(lasts) > SETTLE:
                settled = self._settled(lasts, ways)
                out += self._back(lasts, settled)
                del lasts[:settled]
        return out + self._back(lasts, len(lasts))

    def _head(self, head: bytes) -> tuple[_State, list[int]]:
        """The state after a piece's first bytes, and the last token at each place."""
        if len(self.states) > STATES or len(self.heads) >= HEADS:
            self.forget()
        state, lasts = self.start, []
        for byte in head:
            step = state.next.get(byte)
            if step is None:
                ways, last = self._read(state.ways, byte)
                ways = tuple(ways)
                step = state.next[byte] = self.states.setdefault(ways, _State(ways)), last
            state, last = step
            lasts.append(last)
        self.heads[head] = state, lasts
        return state, lasts

    def _tail(self, tail: bytes) -> tuple[tuple[tuple[int, int], ...], int | None]:
        """The tokens that ``tail`` ends with, the longest first, each with its length, and the place in ``back`` after it."""
        back, back_token, ended, node = self.back, self.back_token, [], 0
        for length, byte in enumerate(reversed(tail), 1):
            node = back[node].get(byte)
            if node is None:
                break
            if (found := back_token[node]) >= 0:
                ended.append((found, length))
        if len(self.tails) >= TAILS:
            self.tails.clear()
        # a tail is shorter than TAIL only where the piece begins, and nothing lies before that
        self.tails[tail] = known = tuple(reversed(ended)), node if node is not None and back[node] else None
        return known

    def _last(self, piece: bytes, lasts: list[int], end: int) -> int:
        """The last token of the piece's first ``end`` bytes."""
        at = end - TAIL if end > TAIL else 0
        tail = piece[at:end]
        ended, node = self.tails.get(tail) or self._tail(tail)
        if at and node is not None:  # longer tokens may end here
            back, back_token, longer = self.back, self.back_token, []
            while at:
                node = back[node].get(piece[at - 1])
                if node is None:
                    break
                at -= 1
                if (found := back_token[node]) >= 0:
                    longer.append((found, end - at))
            if longer:
                longer.reverse()
                ended = (*longer, *ended)
        fit = self.fit
        for found, length in ended:  # the longest first
            at = end - length
            if at == 0:
                break
            before = lasts[at - 1]
            if before < 0:
                before = self._last(piece, lasts, at)
            fits = fit.get(before << 20 | found)
            if fits or (fits is None and self.follows(before, found)):
                break
        lasts[end - 1] = found
        return found

    def _back(self, lasts: list[int], end: int) -> list[int]:
        """The tokens of what was read up to ``end``, which is between tokens."""
        out, length = [], self.length
        while end > 0:
            out.append(token := lasts[end - 1])
            end -= length[token]
        out.reverse()
        return out

    def _settled(self, lasts: list[int], ways: list[tuple[int, int]]) -> int:
        """The last place between tokens that every way has passed through."""
        common: set[int] | None = None
        for node, _ in ways:
            at = len(lasts) - self.depth[node]
            own = {at}
            while at > 0:
                at -= len(self.bytes_of[lasts[at - 1]])
                own.add(at)
            common = own if common is None else common & own
        return max(common)


class Encoder:
    """Encodes texts: pieces by ``pattern``, each by the transducer, frequent words from memory.

    Ids come as decimals joined by blanks. A blank before anything but white space starts
    a piece whatever stands around it, so texts are cut there first.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern).findall
        self.vocabulary = {str(i): b for b, i in ranks.items()}
        self.decimal = {i: str(i) for i in ranks.values()}
        self.known: dict[str, tuple[str, bytes]] = {}  # by word
        self.parts: dict[str, str] = {}  # by piece, which words with different ends share

    def _run(self, text: str) -> tuple[str, bytes]:
        get, make = self.parts.get, self._part
        ids = " ".join([get(p) or make(p) for p in self.pieces(text)])
        return ids, b"".join(map(self.vocabulary.__getitem__, ids.split(" ")))

    def _part(self, piece: str) -> str:
        decimal = self.decimal
        ids = " ".join([decimal[i] for i in self.transducer.encode(piece.encode())])
        if len(piece) < 40:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            self.parts[piece] = ids
        return ids

    def _word(self, word: str) -> tuple[str, bytes]:
        if _LOOSE(word):
            raise _LooseBlank
        run = self._run(" " + word)
        if len(word) < 40:
            if len(self.known) >= PIECES:
                self.known.clear()
            self.known[word] = run
        return run

    def runs(self, text: str) -> list[tuple[str, bytes]]:
        """The ids of ``text`` in runs of one or more, each with the bytes that its ids decode to."""
        if not text:
            return []
        first, *rest = text.split(" ")
        get, make = self.known.get, self._word
        try:
            found = [get(w) or make(w) for w in rest]
            return [self._run(first), *found] if first else found
        except _LooseBlank:
            pass
        start, parts = 0, []
        for m in _STARTS.finditer(text):  # loose blanks stay with what precedes them
            parts.append(text[start : m.start()])
            start = m.start()
        parts.append(text[start:])
        return [self._run(p) for p in parts if p]

    def encode(self, text: str) -> str:
        """The ids of ``text``."""
        return " ".join([ids for ids, _ in self.runs(text)])

    def close(self) -> None:
        """Give back what is remembered."""
        self.known.clear()
        self.parts.clear()
        self.transducer.forget()
        self.transducer.fit.clear()


_STARTS = regex.compile(r" (?=\S)")
_LOOSE = regex.compile(r"\s|$").match


class _LooseBlank(Exception):
    """A blank before white space or the end."""


class Utf8Stream:
    """Bytes in, whole characters out; the state is an unfinished character of at most 3 bytes."""

    def __init__(self) -> None:
        self.open = b""

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data)
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte & 0xC0 == 0x80:  # goes on with a character
                continue
            size = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
            if size > back:
                cut -= back
            break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        """What an unfinished character leaves."""
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def decode(ids: Sequence[str], vocabulary: dict[str, bytes], block: int = 1 << 15) -> Iterator[str]:
    """The text of decimal ``ids``, a stretch at a time."""
    return joined((b"".join(map(vocabulary.__getitem__, ids[at : at + block])) for at in range(0, len(ids), block)))


def joined(parts: Iterable[bytes]) -> Iterator[str]:
    """The text of ``parts``, which may end inside a character."""
    stream = Utf8Stream()
    for part in parts:
        yield stream.feed(part)
    yield stream.end()


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    key = (hash(frozenset(ranks.items())), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``.

    NULL text counts as empty: no tokens, and the hash of nothing. Strings of special
    tokens are ordinary text. Other columns are ignored.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary.value, pattern)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for text in batch.column(1):
                runs = e.runs(text.as_py() or "")
                ids = " ".join([r[0] for r in runs])
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                digest = hashlib.sha256()
                for part in joined(b"".join([r[1] for r in runs[at : at + BLOCK]]) for at in range(0, len(runs), BLOCK)):
                    digest.update(part.encode())
                text_hash.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        # functions travel by value, so the next task of this worker makes an encoder of its own
        e.close()
        _ENCODERS.clear()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3(spark, sf_dir) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), *_public())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, *_public())
