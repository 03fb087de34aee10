"""Inequality joins that count pairs together, against the pairs one by one, and where those are too many to list."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from millrace.plans import interval_joins
from millrace.plans.interval_joins import inequality_join
from millrace.plans.merging import counted, greatest


@pytest.mark.parametrize("sign, by", [("<", ["g"]), ("<=", []), (">", ["g"]), (">=", ["g", "h"])])
def test_inequality_measures_are_those_of_the_pairs(spark, monkeypatch, sign, by):
    monkeypatch.setattr(interval_joins, "CELL", 4)
    rng = random.Random(len(by))
    pick = lambda *some: rng.choice(some)
    left = [(k, pick(None, -0.0, 0.0, 1.5, 2.5, float("nan"), rng.random() * 9)) for k in range(40)]
    right = [(pick(None, 0.0, -0.0, 1.5, float("nan"), rng.random() * 9), pick(None, 1, 2, 3), pick("a", None), pick(None, k)) for k in range(90)]
    frames = spark.createDataFrame([*left, *left[:5]], "k int, a double"), spark.createDataFrame([*right, *right[:9]], "b double, g int, h string, v int")
    got = inequality_join(*frames, ("a", sign, "b"), by, {"n": counted(), "v": greatest("v")})
    pairs = inequality_join(*frames, ("a", sign, "b"))
    # Copies of a left row are pairs of their own, but cannot be told apart in the groups of the plain pairs.
    want = pairs.groupBy("left.k", *[f"right.{c}" for c in by]).agg(F.count(F.lit(1)).alias("n"), F.max("right.v").alias("v"))
    again = got.groupBy("left.k", *[f"right.{c}" for c in by]).agg(F.sum("right.n").alias("n"), F.max("right.v").alias("v"))
    assert got.select("right.*").columns == [*by, "n", "v"]
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(again) == rows(want)
    assert inequality_join(frames[0], frames[1].limit(0), ("a", sign, "b"), by, {"n": counted()}).count() == 0


def test_richer_customers_of_other_nations_where_pairs_are_too_many_to_list(spark, tmp_path):
    n = 100_000
    spark.range(n).selectExpr("id s_suppkey", "CAST(id AS DOUBLE) s_acctbal", "CAST(id % 2 AS INT) s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(n).selectExpr("id c_custkey", "CAST(id AS DOUBLE) c_acctbal", "CAST(id % 2 AS INT) c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = entry_points.queries()["sql_inequality_join"](spark, str(tmp_path))
    row = got.selectExpr("count(*)", "sum(n_richer)", "sum(last_customer)", "count_if(n_richer <> floor((100000 - s_suppkey) / 2))").first()
    # Supplier k meets k + 1, k + 3, ...; the last is n - 1 for an even k, n - 2 for an odd one that still has any.
    assert list(row) == [n - 1, sum((n - k) // 2 for k in range(n - 1)), (n - 1) * (n // 2) + (n - 2) * (n // 2 - 1), 0]
