"""Operator 11 against its SQL and against scoring every document."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest

from millrace.llm import lexical_search
from oracle import connect, difference, duck_rows, spark_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score string", "item_id long, text string, rank string"


def _terms(text: str | None) -> list[str]:
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _by_hand(docs: list, items: list, k: int) -> list[tuple]:
    counts = [(doc, collections.Counter(_terms(text))) for doc, text, _ in docs]
    n, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    wanted: dict = {}
    for item, text, _ in items:
        wanted.setdefault(item, set()).update(_terms(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc, c in counts:
            score = 0
            for t in terms & set(c):
                m = 100 - 90 + (90 * sum(c.values()) * n) // length
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeéß漢7", k=rng.randrange(1, 4))) for _ in range(120)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 90))), "x") for k in range(260)]
    docs += [(900, None, "x"), (901, "", "x"), (902, " .,;\x00\n", "x"), (None, docs[5][1], "x"), (5, docs[5][1], "x"), (5, docs[5][1], "x"), (700, docs[9][1], "x"), (701, "Word_word-WORD É é\u0085", "x")]
    docs += [(903, "lone " + "ab " * 30_000, "x")]
    items = [(k, " ".join(rng.choices(words, k=12)), "y") for k in range(9)] + [(9, None, "y"), (10, "", "y"), (11, docs[5][1], "y"), (11, docs[9][1], "y"), (None, "ab cd", "y"), (12, "nowhere", "y"), (13, "WORD É", "y")]
    return docs, items


@pytest.mark.parametrize("leaf, piece", [(2048, 1 << 24), (4, 1 << 24), (1, 2000)])
def test_equals_scoring_every_document(spark, tables, monkeypatch, leaf, piece):
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    monkeypatch.setattr(lexical_search, "PIECE", piece)
    docs, items = tables
    got = lexical_search.ranked(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), 10)
    assert sorted(map(tuple, got.collect()), key=str) == _by_hand(docs, items, 10)


def test_items_in_several_blocks(spark, tables, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEMS", 200)
    docs, items = tables
    got = lexical_search.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), 3)
    assert sorted(map(tuple, got.collect()), key=str) == _by_hand(docs, items, 3)


def test_empty_tables(spark, tables):
    docs, items = (spark.createDataFrame(t, s) for t, s in zip(tables, (DOCS, ITEMS), strict=True))
    assert lexical_search.ranked(docs.limit(0), items).count() == 0
    assert lexical_search.ranked(docs, items.limit(0)).count() == 0


def test_range_maxima():
    rng = np.random.default_rng(1)
    term = np.sort(rng.integers(0, 5, 400))
    row = np.concatenate([np.sort(rng.permutation(500)[: int((term == t).sum())]) for t in range(5)])
    piece = lexical_search.Piece(np.arange(500), np.full(500, 9), term, row, rng.integers(1, 9, 400), rng.integers(1, 99, 5), 500, 4500)
    low = rng.integers(0, 400, 300)
    high = np.minimum(low + rng.integers(0, 60, 300), piece.start[term[low] + 1])
    want = [int(piece.impact[a:b].max()) if b > a else 0 for a, b in zip(low, high, strict=True)]
    assert piece.maxima(low, np.maximum(low, high)).tolist() == want


def test_query_equals_its_sql(spark, sf_dir):
    assert difference(spark_rows(lexical_search.op11(spark, sf_dir)), duck_rows(connect(sf_dir), lexical_search.OP11_SQL)) is None
