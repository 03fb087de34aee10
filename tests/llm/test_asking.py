"""Texts in many small blocks: operators 5 and 9 must not depend on where blocks are cut."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.llm import asking, near_copies, repeats, textbytes
from test_llm_operators import _classes, _removed, docs, empty, texts  # noqa: F401


@pytest.mark.parametrize("block", [1, 900, 6000])
def test_repeats_over_many_blocks(docs, texts, monkeypatch, block):  # noqa: F811
    monkeypatch.setattr(textbytes, "BLOCK", block)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs, 40).collect()}
    for k, want in enumerate(_removed([(t or "").encode() for t in texts], 40)):
        assert k == 3 or got[k] == want, k


def test_jaccard_over_many_blocks(docs, texts, monkeypatch):  # noqa: F811
    monkeypatch.setattr(textbytes, "BLOCK", 700)
    classes, sizes = _classes({k: t for k, t in enumerate(texts) if k != 3})
    got = {r.doc_id: r for r in near_copies.jaccard_classes(docs.where("doc_id IS NOT NULL")).collect()}
    assert {k: r.component_id for k, r in got.items()} == classes
    assert {k: r.n_shingles for k, r in got.items()} == sizes


def test_stage_carries_any_columns(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "a", 5), (2, text, "b", 6), (3, None, "c", 7), (3, None, "c", 7)]
    kept = near_copies.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, _row string, _all int"), "")
    got = sorted(map(tuple, kept.collect()), key=str)
    assert got[0] in rows[:2] and got[1:] == rows[3:]


def test_answers_are_one_row_for_each_block_and_part(spark):
    part = np.array([0, 0, 1, 1])
    sends = [asking.asked(b, part, np.array([5, 6 + b, 7, 7 + b], np.uint32)) for b in (1, 2, 3)]
    sent = spark.createDataFrame([tuple(r.values()) for s in sends for r in s.to_pylist()], asking.ASKED)
    told = {r.block: [t.asDict() for t in r.told] for r in asking.answers(sent, [(0, asking.SHORT)]).collect()}
    assert {b: len(t) for b, t in told.items()} == {1: 2, 2: 2, 3: 2}
    assert asking.heard(told[2], part).tolist() == [True, False, True, False]
    assert asking.heard(told[1], part, "leads").tolist() == [True, True, True, True]
    assert asking.heard(told[3], part, "leads").tolist() == [False, True, False, True]
