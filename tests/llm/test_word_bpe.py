"""Operator 13 against the tokenizers library, and its forced boundaries against the vocabulary."""

from __future__ import annotations

import hashlib
import random

import pytest

from millrace.llm import word_bpe

DOCS = "doc_id long, text string, n_tokens string"
ODD = [None, "", " ", "\n\n", "a", "A  b\n c", "don't WE'LL 1234567 !!!", "x" * 3000, "=-" * 700, "qx" * 900, "ΣΑΣ ΟΔΟΣ", "İstanbul", "naïve café", "á x̂",
       "日本語🙂👩‍👩‍👧", "\x00\x01ÿ\x1c\x85", "<|endoftext|>", "a<|startoftext|>B<|endoftext|>c", "<|endof", "</w>", "ﬁ Å ǅ", "한 각", "１２ ½ Ⅻ", "\U000323b0xꟚ"]


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def mine(path):
    with open(path, encoding="utf-8") as file:
        return word_bpe.WordBpe(file.read())


def _random_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    pool = ["a", "the", "ing", "E", "'s", "'LL", " ", "  ", "\n", "́", "Σ", "ς", "İ", "7", "２", "\x85", "​", "漢", "🎉", "<|endoftext|>", "<|", "ﬁ", "가", "ᄀ", "ᅡ", "ß", "q", "x", "\xa0"]
    return ["".join(rng.choices(pool, k=rng.randrange(0, 50))) for _ in range(n)] + ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(12)) for _ in range(n)]


def test_equal_to_the_library(mine, library):
    for text in [t or "" for t in ODD] + _random_texts(3, 800):
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids, text[:60]
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_no_token_covers_a_forced_boundary(mine):
    letters = word_bpe.byte_letters()
    for token in mine.vocabulary:
        data = bytes(letters[c] for c in token.removesuffix(mine.end))
        assert mine.cuts(data) == []
    assert mine.cuts(b"jq") == [1]
    word = b"vzthejqzz"
    edges = [0, *mine.cuts(word), len(word)]
    parts = [mine.fragment(word[a:b], b == len(word)) for a, b in zip(edges, edges[1:])]
    assert len(parts) > 1 and sum(parts, ()) == mine.word(word.decode())


def test_heap_and_scan_merge_alike(mine):
    rng = random.Random(9)
    for _ in range(200):
        data = "".join(rng.choices("aeithnsr", k=rng.randrange(1, word_bpe.REMEMBERED))).encode()
        assert mine._merge(data, False) == mine._merge_long([mine.first[0][b] for b in data])


def test_documents(spark, path, library):
    texts = ODD + ODD[4:9] + ["ab " * 40_000, "abcdefgh" * 20_000]
    rows = [(None if k == 3 else k, t, "clash") for k, t in enumerate(texts)]
    got = word_bpe.encode_documents(spark.createDataFrame(rows, DOCS).repartition(3), path).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[3 if r.doc_id is None else r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert word_bpe.encode_documents(spark.createDataFrame([], DOCS), path).count() == 0


def test_query_over_the_whole_table(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = word_bpe.op13(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.n_tokens == len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
