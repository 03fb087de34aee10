"""Golden queries of window functions and the as-of join, cut into even stretches of order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.golden.catalog import golden, load
from millrace.plans.closure import reachable
from millrace.plans.frames import row_frames
from millrace.plans.interval_joins import inequality_join, overlap_join
from millrace.plans.merging import counted, greatest
from millrace.plans.ordered import (
    asof_join,
    first_value,
    lag,
    last_value,
    lead,
    ntile,
    row_number,
    running_sum,
    trailing_sum,
    with_measures,
    with_ranks,
)


@golden(
    "sql_rank",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity, l_partkey,
              row_number() OVER by_all AS rn, rank() OVER by_day AS rk, dense_rank() OVER by_day AS drk,
              ntile(7) OVER by_all AS tile
       FROM lineitem
       WINDOW by_all AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity),
              by_day AS (PARTITION BY l_returnflag ORDER BY l_shipdate)""",
)
def sql_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Three flags hold all lines and many lines share a day; neither decides who works."""
    columns = ["l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    lines = load(spark, sf, "lineitem").select(*columns)
    ranked = with_ranks(lines, ["l_returnflag"], ["l_shipdate"], "rk", "drk")
    placed = with_measures(ranked, ["l_returnflag"], columns[1:], {"rn": row_number(), "tile": ntile(7)})
    return placed.drop("l_shipdate")


@golden(
    "sql_lag_lead",
    """SELECT event_id, event_type, lag(value) OVER w AS before, lead(value) OVER w AS after,
              first_value(value) OVER w AS first, last_value(value) OVER
                (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
def sql_lag_lead(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    measures = {
        "before": lag("value"),
        "after": lead("value"),
        "first": first_value("value"),
        "last": last_value("value"),
    }
    return with_measures(events, ["event_type"], ["ts", "event_id"], measures).drop("ts", "value")


@golden(
    "sql_frames",
    """SELECT event_id, event_type,
              CAST(sum(cents) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
                AS running_cents,
              CAST(sum(cents) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING
                                    AND CURRENT ROW) AS BIGINT) AS hour_cents
       FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)""",
)
def sql_frames(spark: SparkSession, sf: str) -> DataFrame:
    """A running sum by row and a trailing hour by value; neither puts a type in one task."""
    events = load(spark, sf, "events").select(
        "event_id", "event_type", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents")
    )
    running = with_measures(
        events, ["event_type"], ["ts", "event_id"], {"running_cents": running_sum("cents")}
    )
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    both = trailing_sum(running, ["event_type"], micros, 3_600_000_000, {"hour_cents": "cents"})
    return both.drop("ts", "cents")


@golden(
    "asof_join",
    """SELECT e.event_id, e.user_id, p.event_id AS purchase_id, p.value AS purchase_value
       FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
         ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def asof(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with its user's last purchase up to that moment."""
    events = load(spark, sf, "events")
    purchases = events.filter("event_type = 'purchase'").select(
        "user_id", F.col("ts").alias("bought_at"), F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value")
    )
    return asof_join(
        events.select("event_id", "user_id", "ts"),
        purchases,
        ["user_id"],
        "ts",
        "bought_at",
        ["purchase_id", "purchase_value"],
    ).drop("ts")


@golden(
    "sql_overlap_join",
    """WITH spans AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, min(epoch_us(o_orderdate)) AS lo, max(epoch_us(o_orderdate)) AS hi FROM orders GROUP BY 1
                      UNION ALL SELECT 'all', min(epoch_us(o_orderdate)), max(epoch_us(o_orderdate)) FROM orders),
            stays AS (SELECT l_quantity, epoch_us(l_shipdate) AS lo, epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 86400000000 AS hi FROM lineitem)
       SELECT month, count(*) AS n_lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity
       FROM spans JOIN stays ON spans.lo <= stays.hi AND stays.lo <= spans.hi GROUP BY 1""",
)
def sql_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    """Lines in store for a day per piece, against months of orders and one span over all of them."""
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    orders = load(spark, sf, "orders")
    ends = [F.min(at).alias("lo"), F.max(at).alias("hi")]
    spans = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(*ends)
    spans = spans.unionByName(orders.agg(*ends).withColumn("month", F.lit("all")))
    shipped = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    stays = load(spark, sf, "lineitem").select(
        "l_quantity", shipped.alias("lo"), (shipped + F.col("l_quantity").cast("bigint") * 86_400_000_000).alias("hi")
    )
    pairs = overlap_join(spans, stays, ("lo", "hi"), ("lo", "hi"))
    return pairs.groupBy("left.month").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("right.l_quantity").alias("quantity"))


@golden(
    "sql_inequality_join",
    """SELECT s_suppkey, count(*) AS n_richer, max(c_custkey) AS last_customer
       FROM supplier JOIN customer ON s_acctbal < c_acctbal AND s_nationkey <> c_nationkey GROUP BY 1""",
)
def sql_inequality_join(spark: SparkSession, sf: str) -> DataFrame:
    """For each supplier the customers of other nations with a higher balance."""
    suppliers = load(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    customers = load(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    # Customers of one nation stay or go together, so each supplier meets them as one.
    measures = {"n_richer": counted(), "last_customer": greatest("c_custkey")}
    pairs = inequality_join(suppliers, customers, ("s_acctbal", "<", "c_acctbal"), ["c_nationkey"], measures).filter("left.s_nationkey <> right.c_nationkey")
    return pairs.groupBy("left.s_suppkey").agg(F.sum("right.n_richer").alias("n_richer"), F.max("right.last_customer").alias("last_customer"))


@golden(
    "sql_row_frames",
    """SELECT event_id, event_type, CAST(sum(cents) OVER w AS BIGINT) AS sum_cents, count(*) OVER w AS n, first_value(event_id) OVER w AS first_event
       FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
       WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 5 FOLLOWING)""",
)
def sql_row_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of rows over five types that hold all events."""
    events = load(spark, sf, "events").select("event_id", "event_type", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    outputs = {"sum_cents": F.sum("cents"), "n": F.count(F.lit(1)), "first_event": F.first("event_id")}
    return row_frames(events, ["event_type"], ["ts", "event_id"], outputs, 20, 5).drop("ts", "cents")


@golden(
    "sql_sliding_extremes",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_quantity, min(l_extendedprice) OVER w AS low, max(l_extendedprice) OVER w AS high
       FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity ROWS 99 PRECEDING)""",
)
def sql_sliding_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Least and greatest price of the last hundred lines; one flag holds a third of them."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    lines = load(spark, sf, "lineitem").select("l_returnflag", *order, "l_extendedprice")
    outputs = {"low": F.min("l_extendedprice"), "high": F.max("l_extendedprice")}
    return row_frames(lines, ["l_returnflag"], order, outputs, 99).drop("l_shipdate", "l_extendedprice")


@golden(
    "sql_recursive_closure",
    """WITH RECURSIVE edges AS (SELECT c_custkey AS a, lead(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS b FROM customer),
            paths AS (SELECT a, b FROM edges WHERE b IS NOT NULL UNION SELECT p.a, e.b FROM paths p JOIN edges e ON p.b = e.a WHERE e.b IS NOT NULL)
       SELECT a AS c_custkey, count(*) AS n_later, max(b) AS last_customer FROM paths GROUP BY 1""",
)
def sql_recursive_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in chains by segment, hundreds long: how many come after each, and the last."""
    customers = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    edges = with_measures(customers, ["c_mktsegment"], ["c_custkey"], {"next": lead("c_custkey")})
    paths = reachable(edges, "c_custkey", "next", {"n_later": counted(), "last_customer": greatest("next")})
    return paths.groupBy("c_custkey").agg(F.sum("n_later").alias("n_later"), F.max("last_customer").alias("last_customer"))
