"""Operator 12 against its SQL and against scoring every pair."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from millrace.llm import hard_negatives
from oracle import connect, difference, duck_rows, spark_rows

VECTORS = "vec_id long, embedding array<float>, label int, rank string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def _by_hand(rows: list[tuple]) -> list[tuple]:
    taking = []
    for vec, x, label, _ in rows:
        if vec is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            whole = [math.floor(256 * float(np.float32(c))) for c in x]
            taking.append((vec, (label + 1) % 10 if vec % 7 == 0 else label, whole))
    anchors = {}
    for row in sorted(r for r in taking if r[0] % 100 == 0):
        anchors.setdefault(row[0], row)
    out = []
    for anchor, label, a in anchors.values():
        scored = [(-sum(p * q for p, q in zip(a, c, strict=False)), vec, other) for vec, other, c in taking]
        for ps, positive in sorted((s, v) for s, v, other in scored if other == label and v != anchor)[:5]:
            fine = sorted((s, v) for s, v, other in scored if other != label and 30 * -ps <= 100 * -s <= 90 * -ps)[:10]
            out += [(anchor, positive, k, v, -ps, -s) for k, (s, v) in enumerate(fine, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    out: list[tuple] = []
    for k in range(1, 1300):
        label = rng.randrange(4)
        out.append((k, [c + rng.gauss(0, 0.6) for c in centres[label]], label if k % 50 else (k // 50) % 4, "x"))
    out += [out[10]] * 3 + [out[99]] * 2  # repeated rows, an anchor among them
    out += [(700, [0.5] * 6, 3, "x"), (7, [1.0] * 6, 1, "x")]  # other rows under known ids
    out += [(2000, None, 1, "x"), (2001, [1.0] * 6, None, "x"), (2100, [float("nan")] * 6, 1, "x"), (2200, [None] * 6, 1, "x"), (2300, [float("inf")] * 6, 1, "x"), (None, [9.0] * 6, 1, "x")]
    out += [(2400, [0.0] * 6, 2, "x"), (2500, [-1.0] * 6, 9, "x"), (2600, [], 2, "x"), (2700, [2.0, 1.0], 2, "x")]  # no score but 0, alone in its label, other lengths
    return out


@pytest.mark.parametrize("shard, block", [(8192, 256), (97, 3)])
def test_equals_scoring_every_pair(spark, rows, monkeypatch, shard, block):
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == _by_hand(rows)


def test_without_rows_or_anchors(spark, rows):
    frame = spark.createDataFrame(rows, VECTORS)
    assert hard_negatives.mine(frame.limit(0)).count() == 0
    assert hard_negatives.mine(frame.where("vec_id % 100 <> 0")).count() == 0


def test_tree_spans_with_least_edges():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (40, 5))
    tree = hard_negatives.spanning_tree(x)
    seen: set[int] = set()
    for node, parent, length in tree:
        assert parent in seen or (parent == -1 and not seen)
        assert parent < 0 or length == pytest.approx(float(np.linalg.norm(x[node] - x[parent])))
        seen.add(node)
    assert seen == set(range(40))
    far = np.linalg.norm(x[:, None] - x[None], axis=2)
    edges, root = 0.0, list(range(40))
    for a, b in sorted(((a, b) for a in range(40) for b in range(a)), key=lambda e: far[e]):
        if root[a] != root[b]:
            edges += far[a, b]
            root = [root[a] if r == root[b] else r for r in root]
    assert sum(length for _, parent, length in tree if parent >= 0) == pytest.approx(edges)


def test_only_overlapping_candidates_are_scored():
    rng = np.random.default_rng(4)
    near = rng.integers(-9, 9, (20, 8)) + 200  # anchors close together
    shard = hard_negatives.Packed(np.arange(3000), np.zeros(3000, np.int64), rng.integers(-256, 256, (3000, 8)))
    anchors = hard_negatives.Packed(np.arange(20), np.ones(20, np.int64), near)
    scored, low = 0, 250_000
    for node, at, scores in hard_negatives.scores_within(anchors, shard, lambda i: np.ones(3000, bool), lambda i, _: (low, 1 << 60)):
        want = shard.vectors @ near[node]
        assert at.tolist() == np.flatnonzero(want >= low).tolist() and scores.tolist() == want[at].tolist()
        scored += len(at)
    assert scored < 20 * 3000 / 4


def test_query_equals_its_sql(spark, sf_dir):
    assert difference(spark_rows(hard_negatives.op12(spark, sf_dir)), duck_rows(connect(sf_dir), hard_negatives.OP12_SQL)) is None
