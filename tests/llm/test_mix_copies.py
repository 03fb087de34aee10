"""Operator 7 where a source consists of equal rows to a large part, and against a plain version of the sample."""

from __future__ import annotations

import collections

import pytest

from millrace.llm import mixing

DOCS = "doc_id long, text string, source string, taken string"


def _mixed(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(5)).select("row.*", "size", "source_size", "target", mixing.F.col("taken").alias("words")).collect()
    assert len(got) == len(rows)
    taken, target = collections.Counter(), {}
    for r in got:
        assert r["words"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["words"]
        target[r["source"]] = r["target"]
    return got, taken, target


@pytest.mark.parametrize("copies", [1, 3, 400])
def test_targets_are_met_with_equal_rows(spark, copies):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(k, words(k, 20), "a", "x") for k in range(1500)]
    rows += [(5000 + k, words(k, 20), "b", "x") for k in range(400)] + [(9000, words(7, 20), "b", "x")] * copies
    rows += [(9500, words(1, 35), None, "x")] * 300  # a source of one row
    got, taken, target = _mixed(spark, rows)
    for source in target:
        assert abs(taken[source] - target[source]) <= 35, (source, taken, target)
    again, _, _ = _mixed(spark, rows)
    key = lambda rows: collections.Counter((r["doc_id"], r["source"], r["words"]) for r in rows)
    assert key(got) == key(again)


def test_ranks_follow_odds(spark):
    """In a source of one size class the documents taken once more are those of least draw."""
    import hashlib

    rows = [(k, " ".join([f"t{k}"] * 20), s, "x") for s in ("a", "b", "c") for k in range(200)]
    got, taken, target = _mixed(spark, rows)
    for source in "abc":
        own = [r for r in got if r["source"] == source]
        draw = {r["doc_id"]: int(hashlib.md5(f"{r['doc_id']}|{hashlib.md5(r['text'].encode()).hexdigest()}".encode()).hexdigest()[:13], 16) for r in own}
        least = min(r["words"] for r in own)
        more = {r["doc_id"] for r in own if r["words"] > least}
        head = set(sorted(draw, key=draw.get)[: len(more)])
        assert len(more ^ head) <= 2 and abs(taken[source] - target[source]) <= 20


def test_stage_repeats_rows(spark):
    rows = [(k, "a b c d e f", s, "x") for s in ("a", "b") for k in range(50)] + [(7, "a b c d e f", "b", "x")] * 40
    docs = spark.createDataFrame(rows, DOCS)
    assert mixing.stage(spark, docs, "").columns == docs.columns
    assert abs(mixing.stage(spark, docs, "").count() * 6 - 1.5 * 6 * len(rows)) <= 12
    assert mixing.stage(spark, docs.limit(0), "").count() == 0
