"""Bucketed window plans against plain Python on small, unfriendly tables."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.plans import ordered as o
from millrace.plans.positions import Series, value_at, zip_columns


def table(spark, n=400, seed=7):
    """One key with most rows, a NULL key, gaps, ties in ``t`` and NULL values."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = None if i % 11 == 0 else "hot" if rng.random() < 0.7 else rng.choice("abc")
        rows.append((i, key, rng.choice([1, 2, 3, 50, 51, 400, 401, 1000]), rng.choice([None, 1, 2, 3])))
    return rows, spark.createDataFrame(rows, "id int, k string, t int, v int").repartition(5)


def groups(rows, order):
    found = {}
    for row in rows:
        found.setdefault(row[1], []).append(row)
    return {k: sorted(g, key=order) for k, g in found.items()}


# Stretches of even size, and stretches named by the caller.
BUCKETS = pytest.mark.parametrize("bucket", [None, "floor(t / 10)"])


def expression(bucket):
    return None if bucket is None else F.expr(bucket)


@BUCKETS
def test_measures_over_a_total_order(spark, bucket):
    rows, df = table(spark)
    out = o.with_measures(
        df,
        ["k"],
        ["t", "id"],
        {
            "rn": o.row_number(),
            "tile": o.ntile(4),
            "total": o.running_sum("v"),
            "before": o.lag("v"),
            "after": o.lead("v"),
            "first": o.first_value("v"),
            "last": o.last_value("v"),
            "known": o.last_known("v"),
            "whole": o.total("v"),
        },
        expression(bucket),
    )
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows)
    for group in groups(rows, lambda r: (r[2], r[0])).values():
        n, running, seen = len(group), 0, False
        share, spare = divmod(n, 4)
        tiles = [t for t in range(1, 5) for _ in range(share + (t <= spare))]
        for i, row in enumerate(group):
            r = got[row[0]]
            if row[3] is not None:
                running, seen = running + row[3], True
            assert r.rn == i + 1 and r.tile == tiles[i]
            assert r.total == (running if seen else None)
            assert r.before == (group[i - 1][3] if i else None)
            assert r.after == (group[i + 1][3] if i + 1 < n else None)
            assert (r["first"], r["last"]) == (group[0][3], group[-1][3])
            values = [g[3] for g in group if g[3] is not None]
            assert r.whole == (sum(values) if values else None)
            so_far = [g[3] for g in group[: i + 1] if g[3] is not None]
            assert r.known == (so_far[-1] if so_far else None)


@BUCKETS
def test_ranks_with_ties(spark, bucket):
    rows, df = table(spark)
    out = o.with_ranks(df, ["k"], ["t"], "rk", "drk", expression(bucket))
    got = {r.id: r for r in out.collect()}
    for group in groups(rows, lambda r: r[2]).values():
        times = [r[2] for r in group]
        for row in group:
            assert got[row[0]].rk == times.index(row[2]) + 1
            assert got[row[0]].drk == sorted(set(times)).index(row[2]) + 1


def test_fewer_rows_than_tiles(spark):
    df = spark.createDataFrame([(i,) for i in range(3)], "t int")
    out = o.with_measures(df, [], ["t"], {"tile": o.ntile(5)})
    assert sorted(r.tile for r in out.collect()) == [1, 2, 3]


@pytest.mark.parametrize("bucket", [None, lambda t: F.floor(t / 20)])
def test_asof_join(spark, bucket):
    rng = random.Random(3)
    left = [(i, rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(0, 300)])) for i in range(200)]
    right = [(rng.choice(["hot", "a", "b"]), t, None if t % 7 == 0 else t * 10) for t in rng.sample(range(0, 300), 60)]
    out = o.asof_join(
        spark.createDataFrame(left, "id int, k string, t int"),
        spark.createDataFrame(right, "k string, at int, v int"),
        ["k"],
        "t",
        "at",
        ["at", "v"],
        bucket,
    )
    got = {r.id: (r["at"], r.v) for r in out.collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        fitting = [(at, v) for rk, at, v in right if rk == k and k is not None and t is not None and at <= t]
        assert got[i] == (max(fitting) if fitting else (None, None))


def test_range_join(spark):
    rng = random.Random(5)
    points = [(i, rng.choice([None, 50, *range(0, 200)])) for i in range(150)]
    ranges = [(j, *sorted((rng.randrange(200), rng.randrange(200)))) for j in range(20)] + [(99, 10, 5), (98, None, 3)]
    out = o.range_join(
        spark.createDataFrame(points, "i int, p int"),
        spark.createDataFrame(ranges, "j int, lo int, hi int"),
        "p",
        "lo",
        "hi",
        width=15,
    )
    got = sorted((r.i, r.j) for r in out.collect())
    want = sorted(
        (i, j) for i, p in points for j, lo, hi in ranges if p is not None and lo is not None and lo <= p <= hi
    )
    assert got == want


@pytest.mark.parametrize("bucket", [None, "floor(x / 60)"])
def test_exact_quantiles(spark, bucket):
    _, df = table(spark)
    df = df.withColumn("x", F.col("t") * 1.5)
    fractions = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    got = {r.k: r for r in o.exact_quantiles(df, ["k"], "x", fractions, expression(bucket)).collect()}
    plain = [F.expr(f"percentile(x, {fraction})").alias(name) for name, fraction in fractions.items()]
    want = {r.k: r for r in df.groupBy("k").agg(*plain).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][name] - want[k][name]) < 1e-9 for k in want for name in fractions)


@pytest.mark.parametrize("bucket", [False, True])
@pytest.mark.parametrize("width", [1, 50, 400])
def test_trailing_sum(spark, width, bucket):
    rows, df = table(spark)
    out = o.trailing_sum(df.withColumn("one", F.lit(1)), ["k"], F.col("t"), width, {"near": "one", "total": "v"}, bucket)
    got = {r.id: (r.near, r.total) for r in out.collect()}
    assert len(got) == len(rows)
    for i, k, t, _ in rows:
        frame = [r for r in rows if r[1] == k and t - width <= r[2] <= t]
        values = [r[3] for r in frame if r[3] is not None]
        assert got[i] == (len(frame), sum(values) if values else None)


@BUCKETS
def test_a_hot_key_is_cut(spark, bucket):
    """No shuffle is keyed by the key alone except over the per-stretch table."""
    _, df = table(spark)
    plan = (
        o.with_measures(df, ["k"], ["t", "id"], {"rn": o.row_number()}, expression(bucket))
        ._jdf.queryExecution()
        .executedPlan()
        .toString()
    )
    by_key_only = [line for line in plan.splitlines() if "Exchange hashpartitioning(k#" in line and "bucket" not in line]
    assert len(by_key_only) == 1


def test_one_order_value_is_cut_too(spark):
    """All rows of a key tie, and still no stretch holds them all."""
    df = spark.range(0, 4000, 1, 4).selectExpr("1 AS k", "7 AS t", "id")
    cut = o._even_stretches(df, ["k"], ["t"])
    assert cut.groupBy(o._B).count().agg(F.max("count")).first()[0] < 2000
    out = o.with_measures(df, ["k"], ["t"], {"rn": o.row_number()})
    assert sorted(r.rn for r in out.collect()) == list(range(1, 4001))


def test_copies_of_one_row_are_cut_too(spark):
    df = spark.range(0, 4000, 1, 32).selectExpr("1 AS k", "7 AS t")
    cut = o._even_stretches(df, ["k"], ["t"])
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert cut.groupBy(o._B).count().agg(F.max("count")).first()[0] <= 2 * 4000 / count
    out = o.with_measures(df, ["k"], ["t"], {"rn": o.row_number()})
    assert sorted(r.rn for r in out.collect()) == list(range(1, 4001))


def test_rows_without_an_order_value_come_first(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 1, 6), (1, 2, 7), (1, 3, 8)], "k int, t int, v int")
    measures = {"first": o.first_value("v"), "last": o.last_value("v"), "before": o.lag("v"), "after": o.lead("v")}
    out = o.with_measures(df, ["k"], ["t"], measures)
    got = {r.t: (r["first"], r["last"], r.before, r.after) for r in out.collect()}
    assert got == {None: (5, 8, None, 6), 1: (5, 8, 5, 7), 2: (5, 8, 6, 8), 3: (5, 8, 7, None)}


def test_zip_columns(spark):
    a = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "n int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "n int, w string")
    one = spark.createDataFrame([(1, "only")], "n int, u string")
    out = zip_columns(
        spark,
        {
            "v": Series(a, "v", ["n"]),
            "w": Series(b, "w", ["n"]),
            "u": Series(one, "u", ["n"]),
            "flag": [True],
            "nothing": None,
            "five": [1, None, 3, 4, 5],
        },
    )
    assert [tuple(r) for r in out.orderBy("position").collect()] == [
        (0, "a", "x", "only", True, None, 1),
        (1, "b", "y", "only", True, None, None),
        (2, "c", None, "only", True, None, 3),
        (3, None, None, "only", True, None, 4),
        (4, None, None, "only", True, None, 5),
    ]
    assert zip_columns(spark, {}).count() == 0
    assert [tuple(r) for r in zip_columns(spark, {"a": [], "b": "x"}).collect()] == [(0, None, "x")]


def test_value_at(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "n int, v string")
    row = spark.range(1).select(value_at(df, "v", 1, ["n"]).alias("x"), value_at(df, "v", 9, ["n"]).alias("y")).first()
    assert (row.x, row.y) == ("b", None)
