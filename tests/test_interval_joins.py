"""Overlap and inequality joins against all pairs on small tables."""

from __future__ import annotations

import operator
import random

import pytest
from pyspark.sql import functions as F

from millrace.plans import interval_joins
from millrace.plans.interval_joins import inequality_join, overlap_join, points_in_ranges


@pytest.fixture(scope="module", params=[0, 1])
def ranges(request):
    rng = random.Random(request.param)
    out = []
    for k in range(70):
        lo = rng.randrange(0, 60)
        out.append((k, lo, lo + rng.choice([0, 1, 3, 10, -2])))
    return out + [(100, 0, 99), (101, None, 5), (102, 5, None), (103, 7, 7), (103, 7, 7), (104, -50, -40)]


def _pairs(df):
    return sorted((r["left"]["k"], r["right"]["k"]) for r in df.collect())


def _no_nested_loop(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("cell", [2, 256])
def test_overlaps(spark, ranges, monkeypatch, cell):
    monkeypatch.setattr(interval_joins, "CELL", cell)
    left, right = ranges[::2] + [(104, -50, -40)], ranges[1::2] + [(100, 0, 99)]
    frames = [spark.createDataFrame(rows, "k int, lo int, hi int").repartition(3) for rows in (left, right)]
    got = overlap_join(*frames, ("lo", "hi"), ("lo", "hi"))
    assert _no_nested_loop(got)
    whole = lambda r: None not in r and r[1] <= r[2]
    assert _pairs(got) == sorted((a[0], b[0]) for a in left for b in right if whole(a) and whole(b) and a[1] <= b[2] and b[1] <= a[2])


@pytest.mark.parametrize("sign", ["<", "<=", ">", ">="])
def test_inequalities(spark, ranges, monkeypatch, sign):
    monkeypatch.setattr(interval_joins, "CELL", 8)
    left, right = ranges[:30] + ranges[-4:], ranges[30:]
    compare = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[sign]
    got = inequality_join(spark.createDataFrame(left, "k int, lo int, hi int"), spark.createDataFrame(right, "k int, lo int, hi int"), ("lo", sign, "hi"))
    assert _no_nested_loop(got)
    assert _pairs(got) == sorted((a[0], b[0]) for a in left for b in right if a[1] is not None and b[2] is not None and compare(a[1], b[2]))


def test_open_ends_and_empty_sides(spark, ranges):
    frame = spark.createDataFrame(ranges, "k int, lo int, hi int")
    inside = points_in_ranges(frame, frame, F.col("lo"), F.col("lo"), F.col("hi"), open_low=True, open_high=True)
    want = sorted((p[0], r[0]) for p in ranges for r in ranges if None not in (p[1], r[1], r[2]) and r[1] < p[1] < r[2])
    assert sorted((r["points"]["k"], r["ranges"]["k"]) for r in inside.collect()) == want
    assert overlap_join(frame.limit(0), frame, ("lo", "hi"), ("lo", "hi")).count() == 0
    assert inequality_join(frame, frame.limit(0), ("lo", "<", "hi")).count() == 0
    with pytest.raises(ValueError):
        inequality_join(frame, frame, ("lo", "<>", "hi"))


def test_listed_ranges_are_not_broadcast(spark, monkeypatch):
    """Spark's estimate is of the ranges before they are listed by cell."""
    monkeypatch.setattr(interval_joins, "FEW", 100, raising=False)
    monkeypatch.setattr(interval_joins, "LISTED", 100, raising=False)
    points = spark.range(2000).withColumnRenamed("id", "b")
    ranges = spark.range(0, 2000, 20).withColumnRenamed("id", "a")
    pairs = interval_joins.inequality_join(ranges, points, ("a", "<", "b"))
    pairs.write.format("noop").mode("overwrite").save()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan.split("explode")[0]
    assert pairs.count() == sum(1999 - a for a in range(0, 2000, 20))


def test_equal_bounds_are_counted_together(spark, monkeypatch):
    sizes = []
    measured = interval_joins.with_measures

    def spy(df, *rest):
        sizes.append(df.count())
        return measured(df, *rest)

    monkeypatch.setattr(interval_joins, "with_measures", spy)
    left = spark.createDataFrame([(1, 5), (None, 4), (7, 7)], "lo int, hi int")
    right = spark.createDataFrame([(2, 3)] * 500 + [(6, 9)] * 3 + [(None, 1)], "lo int, hi int")
    assert interval_joins.overlap_join(left, right, ("lo", "hi"), ("lo", "hi")).count() == 503
    assert sorted(sizes)[-2:] == [4, 503]  # only the numbering of the points sees every row
