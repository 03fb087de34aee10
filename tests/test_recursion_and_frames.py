"""Fixpoints over long chains and cycles, and frames of rows against plain windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace import session
from millrace.errors import PipelineError
from millrace.plans import closure, frames
from millrace.plans.closure import fixpoint, reachable
from millrace.plans.frames import row_frames


def test_long_chain_and_cycle(spark):
    chain = [(k, k + 1) for k in range(150)]
    cycle = [(1000, 1001), (1001, 1002), (1002, 1000), (1002, 1003)]
    edges = spark.createDataFrame([*chain, *cycle, (None, 5), (7, None), (3, 4)], "a int, b int")
    got = {tuple(r) for r in reachable(edges, "a", "b").collect()}
    ring = {1000, 1001, 1002}
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 151)} | {(i, j) for i in ring for j in ring | {1003}}
    assert reachable(edges.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_closure_of_any_graph_once_per_pair(spark, monkeypatch, block):
    monkeypatch.setattr(closure, "BLOCK", block)
    rng = random.Random(block)
    tree = [(rng.randrange(k), k) for k in range(1, 25)]
    mesh = [(100 + rng.randrange(12), 100 + rng.randrange(12)) for _ in range(14)]
    chain = [(k, k + 1) for k in range(200, 220)]
    ring = [(300 + k, 300 + (k + 1) % 9) for k in range(9)]
    loops = [(400, 400), (205, 205), (303, 303), (219, 219), (500, 501), (501, 500)]
    edges = [*tree, *mesh, *chain, *ring, *loops, *chain[:3], (210, 303), (3, 200)]
    want = set(edges)
    while True:
        more = want | {(a, d) for a, b in want for c, d in edges if b == c}
        if more == want:
            break
        want = more
    got = reachable(spark.createDataFrame(edges, "a int, b long"), "a", "b")
    assert got.dtypes == [("a", "int"), ("b", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pairs_of_a_chain_are_not_written(spark, monkeypatch, tmp_path):
    for module in (closure, session):
        monkeypatch.setattr(module, "shared_folder", lambda _: str(tmp_path))
    pairs = reachable(spark.range(2000).selectExpr("id a", "id + 1 b"), "a", "b")
    n = 2000 * 2001 // 2
    assert pairs.count() == n
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < n  # less than a byte for each


def test_steps_of_the_callers_own(spark):
    seed = spark.createDataFrame([(1, None), (1, None)], "n int, x string")
    got = fixpoint(seed, lambda fresh, known: fresh.select(((F.col("n") * 2) % 11).alias("n"), "x"))
    assert sorted(r.n for r in got.collect()) == list(range(1, 11))
    with pytest.raises(PipelineError):
        fixpoint(seed, lambda fresh, known: fresh.select((F.col("n") + 1).alias("n"), "x"), max_rounds=3)


@pytest.mark.parametrize("cell, preceding, following", [(4, 3, 0), (4, 0, 2), (3, 7, 5), (1024, 2, 2)])
def test_frames_equal_plain_windows(spark, monkeypatch, cell, preceding, following):
    monkeypatch.setattr(frames, "CELL", cell)
    rng = random.Random(cell)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 5, 9]), "x") for k in range(90)]
    df = spark.createDataFrame(rows, "k int, key string, v int, __cell string").drop("__cell").repartition(3)
    outputs = {"low": F.min("v"), "high": F.max("v"), "mean": F.avg("v"), "n": F.count("v"), "first": F.first("v")}
    got = row_frames(df, ["key"], ["k"], outputs, preceding, following)
    window = Window.partitionBy("key").orderBy("k").rowsBetween(-preceding, following)
    want = df.select("*", *[c.over(window).alias(name) for name, c in outputs.items()])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
