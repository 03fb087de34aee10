"""Sketches by day, merged: within their bounds of the exact answers, however they were cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.sketches import build_sketches, read_sketches


def test_merged_sketches_are_near_the_exact_answers(spark):
    df = spark.range(20_000).select(
        (F.col("id") % 30).alias("day"), (F.col("id") % 2).alias("kind"), (F.col("id") % 3000).alias("user"), F.when(F.col("id") % 50 != 0, F.col("id") / 10).alias("v")
    )
    stored = build_sketches(df, ["day", "kind"], ["user"], ["v"])
    assert stored.count() == 30
    got = {r.kind: r for r in read_sketches(stored, ["kind"], {"half": 0.5, "most": 0.9}).collect()}
    for kind in (0, 1):
        own = sorted(r.v for r in df.where(f"kind = {kind} AND v IS NOT NULL").collect())
        assert got[kind].n_rows == 10_000
        assert abs(got[kind].distinct_user - 1500) <= 0.08 * 1500
        for value, fraction in ((got[kind].v_half, 0.5), (got[kind].v_most, 0.9)):
            assert abs(sum(v <= value for v in own) / len(own) - fraction) <= 0.03
    whole = read_sketches(stored, [], {"half": 0.5}).first()
    assert abs(whole.distinct_user - 3000) <= 0.08 * 3000


def test_groups_without_values(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", 4.0)], "day int, user string, v double")
    got = {r.day: r for r in read_sketches(build_sketches(df, ["day"], ["user"], ["v"]), ["day"], {"half": 0.5}).collect()}
    assert (got[1].n_rows, got[1].distinct_user, got[1].v_half) == (1, 0, None)
    assert (got[2].distinct_user, got[2].v_half) == (1, 4.0)
    assert read_sketches(build_sketches(df.limit(0), ["day"], ["user"], ["v"]), ["day"]).count() == 0
