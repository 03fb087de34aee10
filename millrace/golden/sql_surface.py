"""Golden queries of SQL pushed through ``sql_transform``.

Money is summed as decimals, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.golden.catalog import context, golden, load
from millrace.operators.sql import sql_transform
from millrace.plans.ordered import exact_quantiles, range_join
from millrace.plans.sketches import build_sketches, read_sketches
from millrace.session import written_table


def _through_sql(name: str, tables: str, spark_sql: str, oracle: str | None) -> None:
    """Register SQL over the named tables; ``{t}`` stands for table ``t`` in both texts."""
    names = tables.split()

    @golden(name, oracle.format(**{n: n for n in names}) if oracle else None)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ctx = context(spark, sf, *names)
        query = spark_sql.format(**{n: f"{{{{ tables('{n}') }}}}" for n in names})
        return sql_transform(ctx.table(names[0]), {"query": query}, ctx)


def _same(name: str, tables: str, sql: str) -> None:
    _through_sql(name, tables, sql, sql)


_same(
    "sql_projection",
    "customer",
    """SELECT c_custkey, c_name || '/' || c_mktsegment AS label, c_acctbal * 2 AS doubled,
              CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band
       FROM {customer}""",
)
_same(
    "sql_filter",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM {lineitem}
       WHERE l_quantity BETWEEN 5 AND 10 AND l_returnflag LIKE 'R%' AND l_tax IS NOT NULL
         AND l_shipdate >= DATE '1997-01-01' AND NOT l_discount > 0.07""",
)
_same(
    "sql_inner_join",
    "orders customer",
    """SELECT o_orderkey, o_totalprice, c_name, c_mktsegment
       FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
)
_same(
    "sql_outer_join",
    "orders customer",
    """WITH late AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey),
            rich AS (SELECT c_custkey + 37 AS c_custkey, c_acctbal FROM {customer})
       SELECT 'left' AS kind, c_custkey, c_acctbal, o_custkey, n FROM rich LEFT JOIN late ON c_custkey = o_custkey
       UNION ALL
       SELECT 'right', c_custkey, c_acctbal, o_custkey, n FROM rich RIGHT JOIN late ON c_custkey = o_custkey
       UNION ALL
       SELECT 'full', c_custkey, c_acctbal, o_custkey, n FROM rich FULL JOIN late ON c_custkey = o_custkey""",
)
# NOT IN over keys that are never NULL is written as NOT EXISTS: for NOT IN itself Spark
# broadcasts the list whatever its size.
_through_sql(
    "sql_semi_anti",
    "customer orders",
    """SELECT 'semi' AS kind, c_custkey FROM {customer} LEFT SEMI JOIN {orders}
              ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'
       UNION ALL
       SELECT 'anti', c_custkey FROM {customer} LEFT ANTI JOIN {orders}
              ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'
       UNION ALL
       SELECT 'exists', c_custkey FROM {customer} WHERE EXISTS (
              SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
       UNION ALL
       SELECT 'not in', c_custkey FROM {customer} WHERE c_custkey IS NOT NULL AND NOT EXISTS (
              SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""",
    """WITH urgent AS (SELECT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT'),
            pending AS (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P')
       SELECT 'semi' AS kind, c_custkey FROM {customer} WHERE c_custkey IN (FROM urgent)
       UNION ALL SELECT 'anti', c_custkey FROM {customer} WHERE c_custkey NOT IN (FROM urgent)
       UNION ALL SELECT 'exists', c_custkey FROM {customer} WHERE c_custkey IN (FROM pending)
       UNION ALL SELECT 'not in', c_custkey FROM {customer} WHERE c_custkey NOT IN (FROM pending)""",
)
_same(
    "sql_lateral",
    "customer orders",
    """SELECT c_custkey, n_orders, last_order
       FROM {customer}, LATERAL (SELECT count(*) AS n_orders, max(o_orderkey) AS last_order
                                 FROM {orders} WHERE o_custkey = c_custkey)""",
)
_same(
    "sql_aggregate",
    "lineitem",
    """SELECT l_suppkey, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts,
              count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross, avg(l_quantity) AS avg_quantity
       FROM {lineitem} GROUP BY l_suppkey HAVING count(*) >= 2""",
)

_CUBED = """SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g_status,
                   grouping(o_orderpriority) AS g_priority, count(*) AS n, max(o_totalprice) AS top
            FROM {orders} GROUP BY """
for _name, _grouping in (
    ("sql_grouping_sets", "GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())"),
    ("sql_rollup", "ROLLUP (o_orderstatus, o_orderpriority)"),
    ("sql_cube", "CUBE (o_orderstatus, o_orderpriority)"),
):
    _through_sql(
        _name,
        "orders",
        (_CUBED + _grouping).replace("grouping(o_orderstatus)", "CAST(grouping(o_orderstatus) AS BIGINT)").replace(
            "grouping(o_orderpriority)", "CAST(grouping(o_orderpriority) AS BIGINT)"
        ),
        _CUBED + _grouping,
    )


@golden(
    "sql_median",
    """SELECT o_orderpriority, median(o_totalprice) AS median_price,
              quantile_cont(o_totalprice, 0.9) AS p90_price FROM orders GROUP BY o_orderpriority""",
)
def sql_median(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quantiles from counts of distinct prices.

    Plain ``median()`` keeps every distinct value of a group in one task's memory.
    """
    orders = load(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    return exact_quantiles(orders, ["o_orderpriority"], "o_totalprice", {"median_price": 0.5, "p90_price": 0.9})


# Estimates differ between engines, so each is held against the exact value: within four
# times its relative standard deviation, or within its share of ranks.
_through_sql(
    "sql_approx_distinct",
    "lineitem",
    """WITH distinct_counts AS (
         SELECT l_returnflag, count(*) FILTER (WHERE col = 'part') AS parts, count(*) FILTER (WHERE col = 'order') AS orders
         FROM (SELECT DISTINCT l_returnflag, 'part' AS col, l_partkey AS k FROM {lineitem}
               UNION ALL SELECT DISTINCT l_returnflag, 'order', l_orderkey FROM {lineitem}) GROUP BY l_returnflag),
       estimates AS (
         SELECT l_returnflag, approx_count_distinct(l_partkey, 0.05) AS parts, approx_count_distinct(l_orderkey, 0.05) AS orders,
                percentile_approx(l_extendedprice, 0.5, 1000) AS middle FROM {lineitem} GROUP BY l_returnflag),
       ranks AS (
         SELECT l.l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_extendedprice < middle) AS below,
                count(*) FILTER (WHERE l_extendedprice <= middle) AS upto
         FROM {lineitem} l JOIN estimates e ON l.l_returnflag = e.l_returnflag GROUP BY l.l_returnflag)
       SELECT e.l_returnflag, abs(e.parts - d.parts) <= 0.2 * d.parts AS parts_near, abs(e.orders - d.orders) <= 0.2 * d.orders AS orders_near,
              below <= n * 0.502 + 1 AND upto >= n * 0.498 - 1 AS middle_near
       FROM estimates e JOIN distinct_counts d ON e.l_returnflag = d.l_returnflag JOIN ranks r ON e.l_returnflag = r.l_returnflag""",
    """SELECT DISTINCT l_returnflag, true AS parts_near, true AS orders_near, true AS middle_near FROM {lineitem}""",
)
_same(
    "sql_topk",
    "orders",
    """SELECT 'all' AS scope, o_orderkey, o_totalprice FROM (
         SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)
       UNION ALL
       SELECT o_orderpriority, o_orderkey, o_totalprice FROM (
         SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn
         FROM {orders}) WHERE rn <= 10""",
)
_same(
    "sql_set_ops",
    "lineitem part supplier",
    """SELECT 'union' AS op, k FROM (SELECT l_partkey AS k FROM {lineitem} UNION SELECT s_suppkey FROM {supplier})
       UNION ALL
       SELECT 'intersect', k FROM (SELECT p_partkey AS k FROM {part} INTERSECT SELECT s_suppkey FROM {supplier})
       UNION ALL
       SELECT 'except', k FROM (SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey + 37 FROM {lineitem})
       UNION ALL
       SELECT 'except all', k FROM (SELECT l_partkey AS k FROM {lineitem} EXCEPT ALL SELECT p_partkey FROM {part})""",
)
_same("sql_distinct", "lineitem", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM {lineitem}")
_through_sql(
    "sql_pivot",
    "orders",
    """SELECT * FROM (SELECT year(o_orderdate) AS year, o_orderstatus, o_orderkey FROM {orders})
       PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS n_f, 'O' AS n_o, 'P' AS n_p))""",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS n_f,
              nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS n_o,
              nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS n_p
       FROM {orders} GROUP BY 1""",
)
_through_sql(
    "sql_unpivot",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, measure, amount FROM
         (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM {lineitem})
       UNPIVOT (amount FOR measure IN (quantity, discount, tax))""",
    """SELECT l_orderkey, l_linenumber, 'quantity' AS measure, l_quantity AS amount FROM {lineitem}
       UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount FROM {lineitem}
       UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM {lineitem}""",
)
_through_sql(
    "sql_string_fns",
    "customer",
    """SELECT c_custkey, upper(c_mktsegment) AS upper_segment, lower(c_name) AS lower_name, length(c_name) AS n_name,
              substring(c_name, 10, 4) AS middle, trim('  ' || c_mktsegment || '  ') AS trimmed,
              replace(c_name, 'Customer', 'C') AS short, split(c_name, '#')[1] AS tail,
              regexp_replace(c_name, '[0-9]+', 'N') AS masked, lpad(CAST(c_nationkey AS STRING), 4, '0') AS padded,
              reverse(c_mktsegment) AS reversed, contains(c_name, '99') AS has_99, instr(c_name, '#') AS hash_at
       FROM {customer}""",
    """SELECT c_custkey, upper(c_mktsegment) AS upper_segment, lower(c_name) AS lower_name,
              CAST(length(c_name) AS INTEGER) AS n_name, substring(c_name, 10, 4) AS middle,
              trim('  ' || c_mktsegment || '  ') AS trimmed, replace(c_name, 'Customer', 'C') AS short,
              split_part(c_name, '#', 2) AS tail, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS masked,
              lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded, reverse(c_mktsegment) AS reversed,
              contains(c_name, '99') AS has_99, CAST(instr(c_name, '#') AS INTEGER) AS hash_at
       FROM {customer}""",
)
_through_sql(
    "sql_date_fns",
    "orders",
    """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q,
              date_format(date_trunc('MONTH', o_orderdate), 'yyyy-MM-dd') AS month_start,
              datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS age_days,
              date_format(add_months(CAST(o_orderdate AS DATE), 1), 'yyyy-MM-dd') AS next_month,
              date_format(last_day(o_orderdate), 'yyyy-MM-dd') AS month_end, weekday(o_orderdate) AS from_monday
       FROM {orders}""",
    """SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d,
              quarter(o_orderdate)::INTEGER AS q, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
              date_diff('day', o_orderdate::DATE, DATE '2002-01-01')::INTEGER AS age_days,
              strftime(o_orderdate::DATE + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month,
              strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end, (isodow(o_orderdate) - 1)::INTEGER AS from_monday
       FROM {orders}""",
)
_through_sql(
    "sql_math_fns",
    "customer",
    """SELECT c_custkey, abs(c_acctbal) AS magnitude, CAST(floor(c_acctbal) AS DOUBLE) AS down,
              CAST(ceil(c_acctbal) AS DOUBLE) AS up, round(power(c_nationkey, 2), 4) AS squared,
              round(ln(c_custkey + 1), 6) AS logged, round(sqrt(c_custkey), 6) AS rooted, c_custkey % 7 AS remainder,
              c_custkey div 7 AS quotient, sign(c_acctbal) AS signed, greatest(c_nationkey, 10) AS at_least_ten
       FROM {customer}""",
    """SELECT c_custkey, abs(c_acctbal) AS magnitude, floor(c_acctbal) AS down, ceil(c_acctbal) AS up,
              round(power(c_nationkey, 2), 4) AS squared, round(ln(c_custkey + 1), 6) AS logged,
              round(sqrt(c_custkey), 6) AS rooted, c_custkey % 7 AS remainder, c_custkey // 7 AS quotient,
              sign(c_acctbal)::DOUBLE AS signed, greatest(c_nationkey, 10) AS at_least_ten
       FROM {customer}""",
)
_through_sql(
    "sql_array_fns",
    "embeddings",
    """SELECT vec_id, size(embedding) AS n, CAST(array_max(embedding) AS DOUBLE) AS high,
              CAST(element_at(embedding, 1) AS DOUBLE) AS head, size(filter(embedding, x -> x > 0)) AS n_positive,
              CAST(element_at(sort_array(embedding), 2) AS DOUBLE) AS second_lowest,
              aggregate(transform(embedding, x -> CAST(round(x * 1000) AS BIGINT)), 0L, (a, x) -> a + x) AS milli_sum,
              map(label, vec_id)[label] AS looked_up, named_struct('l', label).l AS l,
              size(slice(embedding, 2, 3)) AS n_slice, array_contains(transform(embedding, x -> x > 0.1), true) AS any_large
       FROM {embeddings}""",
    """SELECT vec_id, len(embedding)::INTEGER AS n, list_max(embedding)::DOUBLE AS high, embedding[1]::DOUBLE AS head,
              len(list_filter(embedding, lambda x: x > 0))::INTEGER AS n_positive,
              list_sort(embedding)[2]::DOUBLE AS second_lowest,
              list_sum(list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000) AS BIGINT)))::BIGINT AS milli_sum,
              vec_id AS looked_up, label AS l, len(embedding[2:4])::INTEGER AS n_slice,
              list_contains(list_transform(embedding, lambda x: x > 0.1), true) AS any_large
       FROM {embeddings}""",
)
_through_sql(
    "sql_json_fns",
    "events",
    """SELECT event_id, get_json_object(props, '$.k') AS k_text, from_json(props, 'k BIGINT').k AS k_number,
              variant_get(parse_json(props), '$.k', 'bigint') + 1 AS k_next,
              to_json(named_struct('id', event_id, 'kind', event_type)) AS packed,
              json_array_length('[1,2]') AS n_list
       FROM {events}""",
    """SELECT event_id, json_extract_string(props, '$.k') AS k_text, CAST(json_extract(props, '$.k') AS BIGINT) AS k_number,
              CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k_next,
              '{{"id":' || event_id || ',"kind":"' || event_type || '"}}' AS packed, 2 AS n_list
       FROM {events}""",
)
_through_sql(
    "sql_cte",
    "orders",
    """WITH RECURSIVE span AS (
         SELECT date_trunc('YEAR', min(o_orderdate)) AS lo, max(o_orderdate) AS hi FROM {orders}),
       years(year, hi) AS (
         SELECT lo, hi FROM span
         UNION ALL
         SELECT CAST(year + INTERVAL 1 YEAR AS TIMESTAMP), hi FROM years
         WHERE CAST(year + INTERVAL 1 YEAR AS TIMESTAMP) <= hi),
       months AS (
         SELECT explode(filter(sequence(year, year + INTERVAL 11 MONTH, INTERVAL 1 MONTH), m -> m <= hi)) AS month FROM years),
       sold AS (
         SELECT date_trunc('MONTH', o_orderdate) AS month, count(*) AS n FROM {orders}
         WHERE o_totalprice > (SELECT avg(CAST(o_totalprice AS DECIMAL(18,2))) FROM {orders}) GROUP BY 1)
       SELECT date_format(m.month, 'yyyy-MM') AS month, coalesce(s.n, 0L) AS n
       FROM months m LEFT JOIN sold s ON s.month = m.month""",
    """WITH RECURSIVE span AS (
         SELECT date_trunc('year', min(o_orderdate)) AS lo, max(o_orderdate) AS hi FROM {orders}),
       months(month, hi) AS (
         SELECT lo, hi FROM span
         UNION ALL
         SELECT month + INTERVAL 1 MONTH, hi FROM months WHERE month + INTERVAL 1 MONTH <= hi),
       sold AS (
         SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM {orders}
         WHERE o_totalprice > (SELECT avg(CAST(o_totalprice AS DECIMAL(18,2))) FROM {orders}) GROUP BY 1)
       SELECT strftime(m.month, '%Y-%m') AS month, coalesce(s.n, 0) AS n
       FROM months m LEFT JOIN sold s ON s.month = m.month""",
)


@golden(
    "sql_range_join",
    """WITH spans AS (SELECT date_trunc('month', o_orderdate) AS month, min(epoch(o_orderdate)) AS lo, max(epoch(o_orderdate)) AS hi
                      FROM orders GROUP BY 1)
       SELECT strftime(month, '%Y-%m') AS month, count(*) AS n_lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity
       FROM lineitem JOIN spans ON epoch(l_shipdate) BETWEEN lo AND hi GROUP BY 1""",
)
def sql_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """Lines shipped within the span of a month's orders, by an equi-join on weeks."""
    month = F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM").alias("month")
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    spans = (
        load(spark, sf, "orders")
        .groupBy(month)
        .agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    )
    lines = load(spark, sf, "lineitem").select(
        "l_quantity", F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("at")
    )
    return (
        range_join(lines, spans, "at", "lo", "hi", width=7 * 86400)
        .groupBy("month")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    )


@golden(
    "sql_sketch_merge",
    """SELECT l_returnflag, count(*) AS n_rows, true AS parts_near, true AS middle_near FROM lineitem GROUP BY 1""",
)
def sql_sketch_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches by flag and day are stored, merged by flag, and held against exact answers.

    A count may be off by four relative standard errors, a quantile by 3 percent of ranks.
    """
    lines = load(spark, sf, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("day"), "l_partkey", "l_extendedprice")
    stored = written_table(build_sketches(lines, ["l_returnflag", "day"], ["l_partkey"], ["l_extendedprice"]))
    found = read_sketches(stored, ["l_returnflag"], {"middle": 0.5})
    parts = lines.select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.count("l_partkey").alias("parts"))
    below, upto = F.count_if(F.col("l_extendedprice") < F.col("middle")), F.count_if(F.col("l_extendedprice") <= F.col("middle"))
    middles = found.select("l_returnflag", F.col("l_extendedprice_middle").alias("middle"))
    n = F.count(F.lit(1))
    ranks = lines.join(middles, "l_returnflag").groupBy("l_returnflag").agg(((below <= n * 0.53 + 1) & (upto >= n * 0.47 - 1)).alias("middle_near"))
    near = F.abs(F.col("distinct_l_partkey") - F.col("parts")) <= F.greatest(F.lit(1.0), 4 * 1.04 / 64 * F.col("parts"))
    return found.join(parts, "l_returnflag").join(ranks, "l_returnflag").select("l_returnflag", "n_rows", near.alias("parts_near"), "middle_near")
