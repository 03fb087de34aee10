"""Closures that count pairs together, against the pairs one by one, and where those are too many to list."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from millrace.plans import closure
from millrace.plans.closure import reachable
from millrace.plans.merging import counted, greatest


@pytest.mark.parametrize("block", [1, 3])
def test_closure_measures_are_those_of_the_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(closure, "BLOCK", block)
    rng = random.Random(block)
    tree = [(rng.randrange(k), k) for k in range(1, 25)]
    mesh = [(100 + rng.randrange(12), 100 + rng.randrange(12)) for _ in range(14)]
    chain = [(k, k + 1) for k in range(200, 220)]
    ring = [(300 + k, 300 + (k + 1) % 9) for k in range(9)]
    odd = [(400, 400), (205, 205), (303, 303), (219, 219), (500, 501), (501, 500), (None, 5), (7, None), (1 << 40, 600), (600, 601)]
    edges = spark.createDataFrame([*tree, *mesh, *chain, *ring, *odd, *chain[:3], (210, 303), (3, 200)], "a long, b int")
    got = reachable(edges, "a", "b", {"n": counted(), "last": greatest("b")})
    assert got.dtypes == [("a", "bigint"), ("n", "bigint"), ("last", "int")]
    want = reachable(edges, "a", "b").groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max("b").alias("last"))
    assert sorted(map(tuple, got.groupBy("a").agg(F.sum("n"), F.max("last")).collect())) == sorted(map(tuple, want.collect()))
    assert reachable(edges.limit(0), "a", "b", {"n": counted()}).count() == 0


def test_later_customers_where_pairs_are_too_many_to_list(spark, tmp_path):
    n = 200_000
    spark.range(n).selectExpr("id c_custkey", "IF(id < 5, 'few', 'many') c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    got = entry_points.queries()["sql_recursive_closure"](spark, str(tmp_path))
    row = got.selectExpr("count(*)", "sum(n_later)", "count_if(n_later <> last_customer - c_custkey)", "count_if(last_customer <> IF(c_custkey < 5, 4, 199999))").first()
    many = n - 5
    assert list(row) == [n - 2, 10 + many * (many - 1) // 2, 0, 0]
