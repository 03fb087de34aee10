"""Golden queries of pipelines, steps, positional reads and the streaming form."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import MissingTable
from millrace.functions.json_paths import json_matches, json_path
from millrace.functions.paths import nested_column
from millrace.golden.catalog import context, fresh_folder, golden, load
from millrace.golden.enveloped import _PRODUCT_COLUMNS, product_responses
from millrace.operators.sql import sql_transform
from millrace.plans.history import History
from millrace.plans.pipeline import (
    input_table,
    loop_requests,
    present,
    resolve_scalar,
    run_pipeline,
    transform_chain,
    union_by_name,
)
from millrace.plans.positions import Series, value_at, zip_columns
from millrace.plans.spec import Rule
from millrace.streaming.accumulate import accumulate_stream


# -- tables and SQL --------------------------------------------------------------------


@golden(
    "sql_transform",
    """SELECT c_custkey, c_name, 'seg:' || c_mktsegment AS label FROM customer
       WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 AND c_name LIKE 'Customer#%'""",
)
def sql_step(spark: SparkSession, sf: str) -> DataFrame:
    ctx = context(
        spark,
        sf,
        "customer",
        inputs={"segment": "BUILDING", "floor": 1000, "prefix": "Customer#"},
        session={"user": {"tag": "seg"}},
    )
    return sql_transform(
        ctx.table("customer"),
        {
            "query": "SELECT c_custkey, c_name, '{{ session.user.tag }}:' || c_mktsegment AS label"
            " FROM {{ active_table }} WHERE c_mktsegment = '{{ inputs.segment }}'"
            " AND c_acctbal >= {{ inputs.floor }} AND c_name LIKE '{{ inputs.prefix }}%'"
        },
        ctx,
    )


@golden("execute_sql", "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'O'")
def execute_sql(spark: SparkSession, sf: str) -> DataFrame:
    ctx = context(spark, sf, "orders")
    return ctx.sql(
        "SELECT count(*) AS n, max(o_totalprice) AS top FROM {{ tables('orders') }} WHERE o_orderstatus = :status",
        args={"status": "O"},
    )


@golden("read_table", "SELECT s_suppkey, s_name FROM supplier")
def read_table(spark: SparkSession, sf: str) -> DataFrame:
    return context(spark, sf, "supplier").table("supplier").select("s_suppkey", "s_name")


@golden("register_table", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def register_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs hold different tables under one name; each reads its own, the latest one."""
    ours, other = context(spark, sf, "customer"), context(spark, sf)
    other.register("customer", load(spark, sf, "nation"))
    ours.register("by_segment", load(spark, sf, "region"))
    ours.register("by_segment", ours.sql("SELECT c_mktsegment, count(*) AS n FROM {{ schema }}.customer GROUP BY 1"))
    return ours.sql("SELECT * FROM {{ tables('by_segment') }}")


@golden(
    "table_input_join",
    """SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 5 ELSE 1 END::BIGINT AS weight
       FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def table_input_join(spark: SparkSession, sf: str) -> DataFrame:
    wanted = input_table(
        spark,
        [{"segment": "BUILDING", "weight": 5}, {"segment": "MACHINERY"}],
        [{"name": "segment"}, {"name": "weight", "type": "integer", "default": 1}],
    )
    customers = load(spark, sf, "customer")
    return customers.join(wanted, customers.c_mktsegment == wanted.segment).select("c_custkey", "c_mktsegment", "weight")


@golden("present_columns", """SELECT o_orderpriority AS "Priority", o_orderkey AS "Order" FROM orders""")
def present_columns(spark: SparkSession, sf: str) -> DataFrame:
    config = {
        "columns": [
            {"field": "o_orderpriority", "title": "Priority", "visible": True},
            {"field": "o_custkey", "title": "Customer", "visible": False},
            {"field": "o_orderkey", "title": "Order"},
        ]
    }
    return present(load(spark, sf, "orders"), config)


@golden(
    "transform_chain",
    """SELECT o_orderpriority, count(o_orderkey) AS o_orderkey_count, max(o_totalprice) AS o_totalprice_max
       FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority""",
)
def chain(spark: SparkSession, sf: str) -> DataFrame:
    ctx = context(spark, sf, "orders")
    rules = [
        Rule("sql_transform", {"query": "SELECT *, nullif(o_orderstatus, 'P') AS status FROM {{ active_table }}"}),
        Rule("handle_nulls", {"strategy": "drop", "subset": ["status"]}),
        Rule("group_by", {"by": ["o_orderpriority"], "agg": {"o_orderkey": "COUNT", "o_totalprice": "MAX"}}),
    ]
    return transform_chain(ctx.table("orders"), rules, ctx)


@golden(
    "union_by_name",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier
       UNION ALL SELECT p_partkey, p_name, NULL, NULL FROM part""",
)
def union(spark: SparkSession, sf: str) -> DataFrame:
    customers = load(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    suppliers = load(spark, sf, "supplier").selectExpr("s_name AS name", "s_suppkey AS id", "s_acctbal AS balance")
    parts = load(spark, sf, "part").selectExpr("p_partkey AS id", "p_name AS name")
    return union_by_name([customers, suppliers, parts])


# -- pipelines -------------------------------------------------------------------------

FLAGSHIP = {
    "workflow_id": "orders_by_segment",
    "inputs": [{"name": "since", "type": "string", "default": "1996-01-01"}],
    "steps": [
        {
            "step_id": "join_customers",
            "inputs": ["orders"],
            "transformations": [
                {
                    "operator": "sql_transform",
                    "params": {
                        "query": "SELECT o.o_orderkey, c.c_mktsegment,"
                        " CASE WHEN o.o_orderstatus <> 'P' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) END AS price"
                        " FROM {{ active_table }} o JOIN {{ tables('customer') }} c ON o.o_custkey = c.c_custkey"
                        " WHERE o.o_orderdate >= CAST('{{ inputs.since }}' AS TIMESTAMP_NTZ)"
                    },
                }
            ],
            "output_dataset": "priced",
        },
        {
            "step_id": "settled_only",
            "inputs": ["priced"],
            "transformations": [{"operator": "handle_nulls", "params": {"strategy": "drop", "subset": ["price"]}}],
            "output_dataset": "settled",
        },
        {
            "step_id": "by_segment",
            "inputs": ["settled"],
            "transformations": [
                {
                    "operator": "group_by",
                    "params": {"by": ["c_mktsegment"], "agg": {"o_orderkey": "COUNT", "price": "SUM"}},
                },
                {
                    "operator": "sql_transform",
                    "params": {
                        "query": "SELECT c_mktsegment, o_orderkey_count AS n_orders,"
                        " CAST(price_sum AS DOUBLE) AS revenue FROM {{ active_table }}"
                    },
                },
            ],
            "output_dataset": "report",
        },
    ],
}


def _flagship_run(spark: SparkSession, sf: str):
    tables = {name: load(spark, sf, name) for name in ("orders", "customer")}
    return run_pipeline(spark, FLAGSHIP, tables=tables)


@golden(
    "pipeline_flagship",
    """SELECT c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus <> 'P' GROUP BY c_mktsegment""",
)
def pipeline_flagship(spark: SparkSession, sf: str) -> DataFrame:
    return _flagship_run(spark, sf).result()


_AUDIT_SQL = """WITH priced AS (SELECT c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey
                       WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
            settled AS (SELECT * FROM priced WHERE o_orderstatus <> 'P')
       SELECT 0::INTEGER AS step_no, 'join_customers' AS step_id, 'priced' AS output_dataset, 'success' AS status,
              count(*) AS rows_processed, true AS timed, NULL::VARCHAR AS error FROM priced
       UNION ALL SELECT 1, 'settled_only', 'settled', 'success', count(*), true, NULL FROM settled"""


def _timed(audit: DataFrame) -> DataFrame:
    return audit.select("step_no", "step_id", "output_dataset", "status", "rows_processed", (F.col("started") <= F.col("ended")).alias("timed"), "error")


@golden(
    "step_audit",
    _AUDIT_SQL + " UNION ALL SELECT 2, 'by_segment', 'report', 'success', count(DISTINCT c_mktsegment), true, NULL FROM settled",
)
def step_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Counts taken while the last step's rows are computed, from one scan of each table."""
    tables = {name: load(spark, sf, name) for name in ("orders", "customer")}
    return _timed(run_pipeline(spark, FLAGSHIP, tables=tables, audit=True).audit())


@golden(
    "step_audit_failed",
    _AUDIT_SQL + " UNION ALL SELECT 2, 'ask', 'ds_answers', 'failed', NULL, true, 'MissingTable: no captured responses for ''nowhere'''",
)
def step_audit_failed(spark: SparkSession, sf: str) -> DataFrame:
    """A run whose last step fails leaves a row for it."""
    tables = {name: load(spark, sf, name) for name in ("orders", "customer")}
    ask = {"step_id": "ask", "driver": "json", "endpoint": "nowhere", "output_dataset": "ds_answers"}
    try:
        run_pipeline(spark, {**FLAGSHIP, "steps": [*FLAGSHIP["steps"][:2], ask]}, tables=tables, audit=True)
    except MissingTable as error:
        return _timed(error.run.audit())
    raise AssertionError("the step has no responses and must fail")


@golden("passthrough", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def passthrough(spark: SparkSession, sf: str) -> DataFrame:
    spec = {"workflow_id": "copy", "steps": [{"step_id": "copy", "inputs": ["nation"], "output_dataset": "ds_copy"}]}
    return run_pipeline(spark, spec, tables={"nation": load(spark, sf, "nation")}).table("ds_copy")


def _catalogue_responses(spark: SparkSession, sf: str) -> DataFrame:
    """One search response per brand and part: the captured answers of a catalogue."""
    return product_responses(spark, sf).join(
        load(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("category")),
        "product_id",
    )


@golden(
    "batch_step",
    """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_brand AS brand
       FROM part WHERE p_brand = 'Brand#1' AND p_name LIKE '%widget%'""",
)
def batch_step(spark: SparkSession, sf: str) -> DataFrame:
    spec = {
        "workflow_id": "search",
        "inputs": [{"name": "category", "default": "Brand#1"}],
        "steps": [
            {
                "step_id": "search",
                "driver": "xml",
                "endpoint": "catalogue/search",
                "variables": {
                    "ds_search": {
                        "type": "dataset",
                        "columns": [{"field": "global_input.category", "alias": "category"}],
                    }
                },
                "response": {"columns": ["product_id", "product_name", "brand"]},
                "transformations": [
                    {"operator": "handle_nulls", "params": {"strategy": "drop", "subset": ["product_id"]}},
                    {
                        "operator": "filter",
                        "params": {"conditions": [{"field": "product_name", "operator": "CONTAINS", "value": "widget"}]},
                    },
                ],
                "error_handling": {"code_field": "ErrorCode", "msg_field": "ErrorMsg", "on_error": "fail"},
                "output_dataset": "ds_found",
            }
        ],
    }
    responses = {"catalogue/search": _catalogue_responses(spark, sf)}
    return run_pipeline(spark, spec, responses=responses).result()


@golden(
    "chained_enrichment",
    """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_brand AS brand,
              CAST(p_size AS VARCHAR) AS stock_quantity,
              CASE WHEN p_size <= 40 THEN CAST(p_size AS VARCHAR) END AS sale_price
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def chained_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """A detail response for every line item, three datasets side by side."""
    return _details(spark, load(spark, sf, "lineitem"), product_responses(spark, sf)).result()


def _details(spark: SparkSession, lines: DataFrame, responses: DataFrame):
    spec = {
        "workflow_id": "details",
        "steps": [
            {
                "step_id": "details",
                "driver": "xml",
                "mode": "chained_loop",
                "endpoint": "catalogue/detail",
                "inputs": ["lines"],
                "variables": {"datasets": {"ds_condition": [{"product_id": "{{ loop_row.l_partkey }}"}]}},
                "response": {"join": {"datasets": _PRODUCT_COLUMNS, "on": ["product_id"]}},
                "error_handling": {"code_field": "ErrorCode", "msg_field": "ErrorMsg", "on_error": "skip_row"},
                "output_dataset": "ds_details",
            }
        ],
    }
    return run_pipeline(spark, spec, tables={"lines": lines}, responses={"catalogue/detail": responses})


def _all_details(spark: SparkSession, sf: str):
    """All line items; one part in ten has no response."""
    return _details(spark, load(spark, sf, "lineitem"), product_responses(spark, sf).filter("product_id % 10 <> 3"))


@golden(
    "chained_enrichment_all",
    """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_brand AS brand,
              CAST(p_size AS VARCHAR) AS stock_quantity,
              CASE WHEN p_size <= 40 THEN CAST(p_size AS VARCHAR) END AS sale_price
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 10 <> 3""",
)
def chained_enrichment_all(spark: SparkSession, sf: str) -> DataFrame:
    return _all_details(spark, sf).result()


@golden(
    "chained_enrichment_errors",
    """SELECT DISTINCT l_partkey AS product_id, 'transport' AS outcome, 'no response' AS err_msg
       FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE p_partkey IS NULL OR p_partkey % 10 = 3""",
)
def chained_enrichment_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The parts that were asked for and have no response."""
    return _all_details(spark, sf).errors["details"].select("product_id", "outcome", "err_msg")


def _stock(requests: list[dict]) -> list[tuple[int, str]]:
    """Stands for a remote service: it knows parts by number and answers from that alone."""
    if any(r["part"] % 10 == 3 for r in requests):
        raise ConnectionError("service does not know this part")
    replies = []
    for r in requests:
        status = 503 if r["part"] % 10 == 7 else 200
        body = {"code": 404 if r["part"] % 10 == 9 else 200, "message": "sold out", "data": [{"part": r["part"], "stock": r["part"] * 7 % 90}]}
        replies.append((status, json.dumps(body)))
    return replies


def _fetched_stock(spark: SparkSession, sf: str):
    spec = {
        "workflow_id": "stock",
        "steps": [
            {
                "step_id": "stock",
                "driver": "json",
                "mode": "chained_loop",
                "endpoint": "stock",
                "inputs": ["lines"],
                "variables": {"parameters": {"part": "{{ loop_row.l_partkey }}"}},
                "response": {"columns": {"part": "bigint", "stock": "bigint"}},
                "error_handling": {"code_field": "code", "msg_field": "message", "on_error": "skip_row"},
                "output_dataset": "ds_stock",
            }
        ],
    }
    return run_pipeline(spark, spec, tables={"lines": load(spark, sf, "lineitem")}, fetchers={"stock": _stock})


@golden(
    "chained_fetch_hook",
    """SELECT l_partkey AS part, l_partkey * 7 % 90 AS stock FROM lineitem WHERE l_partkey % 10 NOT IN (3, 7, 9)""",
)
def chained_fetch_hook(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item with what a function of the caller fetched for its part."""
    return _fetched_stock(spark, sf).result()


@golden(
    "chained_fetch_errors",
    """SELECT DISTINCT l_partkey AS part, CASE l_partkey % 10 WHEN 9 THEN 'business' ELSE 'transport' END AS outcome,
              CASE l_partkey % 10 WHEN 7 THEN '503' WHEN 9 THEN '404' END AS err_code,
              CASE l_partkey % 10 WHEN 3 THEN 'ConnectionError: service does not know this part' WHEN 9 THEN 'sold out' END AS err_msg
       FROM lineitem WHERE l_partkey % 10 IN (3, 7, 9)""",
)
def chained_fetch_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The parts whose fetching failed, each once."""
    return _fetched_stock(spark, sf).errors["stock"].select("part", "outcome", "err_code", "err_msg")


@golden(
    "batch_step_errors",
    """SELECT DISTINCT l_partkey AS product_id, 'transport' AS outcome, 'no response' AS err_msg
       FROM lineitem WHERE l_partkey % 10 = 3""",
)
def batch_step_errors(spark: SparkSession, sf: str) -> DataFrame:
    """A batch request for the parts of all line items: the ids that nobody answered."""
    spec = {
        "workflow_id": "lookup",
        "steps": [
            {
                "step_id": "lookup",
                "driver": "xml",
                "endpoint": "catalogue/detail",
                "variables": {
                    "ds_search": {"type": "dataset", "columns": [{"field": "lines.l_partkey", "alias": "product_id"}]}
                },
                "response": {"columns": ["product_id", "product_name"]},
                "error_handling": {"code_field": "ErrorCode", "msg_field": "ErrorMsg", "on_error": "skip_row"},
                "output_dataset": "ds_found",
            }
        ],
    }
    answered = product_responses(spark, sf).filter("product_id % 10 <> 3")
    run = run_pipeline(spark, spec, tables={"lines": load(spark, sf, "lineitem")}, responses={"catalogue/detail": answered})
    return run.errors["lookup"].select("product_id", "outcome", "err_msg")


@golden(
    "condition_branch",
    """SELECT o_orderpriority AS bucket, count(*) AS n FROM orders GROUP BY 1""",
)
def condition_branch(spark: SparkSession, sf: str) -> DataFrame:
    """There are open orders, so the route jumps past the step that would report statuses."""

    def report(step_id: str, column: str, target: str) -> dict:
        query = f"SELECT {column} AS bucket, count(*) AS n FROM {{{{ tables('orders') }}}} GROUP BY 1"
        return {
            "step_id": step_id,
            "transformations": [{"operator": "sql_transform", "params": {"query": query}}],
            "routing": {"next_step": target},
            "output_dataset": "ds_report",
        }

    spec = {
        "workflow_id": "branch",
        "steps": [
            {
                "step_id": "start",
                "inputs": ["orders"],
                "output_dataset": "ds_start",
                "routing": {
                    "next_step": "by_priority",
                    "condition": "SELECT count(*) > 0 FROM {{ tables('ds_start') }} WHERE o_orderstatus = 'O'",
                },
            },
            report("by_status", "o_orderstatus", "END"),
            report("by_priority", "o_orderpriority", "END"),
        ],
    }
    return run_pipeline(spark, spec, tables={"orders": load(spark, sf, "orders")}).result()


@golden(
    "loop_request_bodies",
    """SELECT o_orderkey, '{"site":"EU","ds_condition":[{"customer":' || o_custkey || ',"status":"' || o_orderstatus
              || '"}]}' AS body
       FROM orders""",
)
def loop_request_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """The body a loop step would send for every order."""
    spec = {
        "workflow_id": "ask",
        "steps": [
            {
                "step_id": "ask",
                "driver": "json",
                "mode": "chained_loop",
                "endpoint": "customers/detail",
                "inputs": ["orders"],
                "variables": {
                    "site": {"source": "session.site", "default": "EU"},
                    "ds_condition": {
                        "type": "dataset",
                        "columns": [
                            {"field": "loop_row.o_custkey", "alias": "customer"},
                            {"field": "loop_row.o_orderstatus", "alias": "status"},
                        ],
                    },
                },
                "output_dataset": "ds_answers",
            }
        ],
    }
    bodies = loop_requests(spark, spec, "ask", tables={"orders": load(spark, sf, "orders")})
    return bodies.select("o_orderkey", "body")


# -- positional reads --------------------------------------------------------------------


@golden(
    "resolve_scalar",
    """SELECT o_orderkey, o_totalprice, (SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1) AS best,
              'none' AS absent
       FROM orders WHERE o_custkey = (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1)""",
)
def scalar(spark: SparkSession, sf: str) -> DataFrame:
    ctx = context(spark, sf, "customer", "orders")
    ctx.register("ranked", ctx.sql("SELECT c_custkey, c_name, -c_acctbal AS owed FROM {{ tables('customer') }}"))
    order = ["owed", "c_custkey"]
    return (
        ctx.table("orders")
        .filter(F.col("o_custkey") == resolve_scalar(ctx, "ranked.c_custkey", order_by=order))
        .select(
            "o_orderkey",
            "o_totalprice",
            resolve_scalar(ctx, "ranked.output.c_name[0]", order_by=order).alias("best"),
            resolve_scalar(ctx, "nowhere.column", default="none").alias("absent"),
        )
    )


@golden(
    "resolve_index",
    """SELECT r_name, (SELECT c_name FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 2) AS third,
              (SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1 OFFSET 4) AS fifth_poorest,
              CAST(NULL AS VARCHAR) AS beyond
       FROM region""",
)
def index(spark: SparkSession, sf: str) -> DataFrame:
    customers = load(spark, sf, "customer")
    nations = load(spark, sf, "nation")
    return load(spark, sf, "region").select(
        "r_name",
        value_at(customers, "c_name", 2, ["c_custkey"]).alias("third"),
        value_at(customers, "c_custkey", 4, ["c_acctbal", "c_custkey"]).alias("fifth_poorest"),
        value_at(nations, "n_name", 1000, ["n_nationkey"]).alias("beyond"),
    )


@golden(
    "dataset_zip",
    """WITH c AS (SELECT c_name, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer),
            s AS (SELECT s_name, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS position FROM supplier)
       SELECT position, c_name AS customer, c_nationkey AS nation, s_name AS supplier, 'EU' AS site,
              CASE position WHEN 0 THEN 10 WHEN 1 THEN 20 END::BIGINT AS code
       FROM c FULL JOIN s USING (position)""",
)
def dataset_zip(spark: SparkSession, sf: str) -> DataFrame:
    customers, suppliers = load(spark, sf, "customer"), load(spark, sf, "supplier")
    return zip_columns(
        spark,
        {
            "customer": Series(customers, "c_name", ["c_custkey"]),
            "nation": Series(customers, "c_nationkey", ["c_custkey"]),
            "supplier": Series(suppliers, "s_name", ["s_acctbal", "s_suppkey"]),
            "site": "EU",
            "code": [10, 20],
        },
    )


@golden(
    "nested_path",
    """SELECT c_custkey, c_mktsegment AS segment, 'home' AS second_kind, CAST(NULL AS VARCHAR) AS beyond,
              c_nationkey::VARCHAR || '|' || 'home' AS kinds, c_name AS tagged
       FROM customer""",
)
def nested_path(spark: SparkSession, sf: str) -> DataFrame:
    def entry(kind: Column) -> Column:
        return F.struct(kind.alias("kind"))

    nested = load(spark, sf, "customer").select(
        "c_custkey",
        F.struct(F.struct(F.col("c_mktsegment").alias("segment")).alias("market")).alias("profile"),
        F.array(entry(F.col("c_nationkey").cast("string")), entry(F.lit("home"))).alias("places"),
        F.create_map(F.lit("name"), F.col("c_name")).alias("tags"),
    )
    return nested.select(
        "c_custkey",
        nested_column(nested, "profile.market.segment").alias("segment"),
        nested_column(nested, "places.1.kind").alias("second_kind"),
        nested_column(nested, "places.kind[7]").alias("beyond"),
        F.array_join(nested_column(nested, "places.kind"), "|").alias("kinds"),
        nested_column(nested, "tags.name").alias("tagged"),
    )


@golden(
    "json_path",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS gone,
              coalesce(json_extract_string(props, '$.k'), '1') AS every
       FROM events""",
)
def json_paths(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").withColumn("doc", F.concat(F.lit('{"list":['), "props", F.lit(',{"k":1}]}')))
    return events.select(
        "event_id",
        json_path("props", "$.k").alias("k"),
        json_path("props", "$.gone").alias("gone"),
        json_path("doc", "$.list[*].k").alias("every"),
    )


@golden(
    "json_path_full",
    """WITH o AS (SELECT l_orderkey, list_sort(list({'n': l_linenumber, 'part': l_partkey, 'qty': l_quantity})) AS lines FROM lineitem GROUP BY 1)
       SELECT l_orderkey, array_to_string([l.part FOR l IN lines IF l.qty > 25], '|') AS filtered,
              array_to_string([l.part FOR l IN lines IF l.qty > 10 AND l.qty <= 40 AND l.n != 2], '|') AS both,
              array_to_string([l.n FOR l IN lines[2:3]], '|') AS sliced, array_to_string([l.n FOR l IN lines[-2:]], '|') AS tail,
              array_to_string([l.n FOR l IN list_concat(lines[1:1], lines[3:3])], '|') AS united,
              lines[-1].part::VARCHAR AS last, array_to_string([l.part FOR l IN list_concat(lines[1:1], lines)], '|') AS everywhere,
              array_to_string([l.part FOR l IN lines], '|') AS members, NULL::VARCHAR AS bad
       FROM o""",
)
def json_path_full(spark: SparkSession, sf: str) -> DataFrame:
    """Filters, slices, unions and descent over a document for every order."""
    lines = load(spark, sf, "lineitem").select(
        "l_orderkey", F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty")).alias("line")
    )
    listed = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    head = F.struct(F.struct(F.get("lines", F.lit(0)).getField("part").alias("part")).alias("line")).alias("head")
    docs = listed.select("l_orderkey", F.to_json(F.struct(head, "lines")).alias("doc")).withColumn("parsed", F.try_parse_json("doc"))
    joined = {
        "filtered": "$.lines[?(@.qty > 25)].part",
        "both": "$.lines[?(@.qty > 10 & @.qty <= 40 & @.n != 2)].part",
        "sliced": "$.lines[1:3].n",
        "tail": "$.lines[-2:].n",
        "united": "$.lines[0,2].n",
        "everywhere": "$..part",
        "members": "$['lines'][*]['part']",
    }
    found = [F.array_join(json_matches("doc", path, "parsed"), "|").alias(name) for name, path in joined.items()]
    return docs.select("l_orderkey", *found, json_path("doc", "$.lines[-1].part", "parsed").alias("last"), json_path("doc", "$.lines[?").alias("bad"))


# -- streaming ---------------------------------------------------------------------------


@golden(
    "stream_accumulate",
    """SELECT event_id, user_id, event_type, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def stream_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    schema = load(spark, sf, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    folder = fresh_folder(spark)
    history = History(spark, f"{folder}/latest", keys=["user_id"], order_by="ts DESC, event_id DESC", buckets=8)
    rows = arriving.select("event_id", "ts", "user_id", "event_type", "value")
    accumulate_stream(rows, history, f"latest_{folder[-8:]}", f"{folder}/checkpoint").awaitTermination()
    return history.read().drop("ts")
