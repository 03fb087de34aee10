"""Golden queries of response envelopes: bodies are derived from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.golden.catalog import golden, load
from millrace.sources.json_records import build_json_request, json_records, parse_json
from millrace.sources.outcomes import split_errors, tag_json, tag_xml
from millrace.sources.xml_envelope import (
    build_parameters_envelope,
    build_xml_envelope,
    datasets_join,
    envelope_parameters,
    envelope_rows,
    parse_xml_envelope,
)


def _xml(*parts: str | Column) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("body")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _cell(name: str, column: str) -> list[str | Column]:
    return [f'<Col id="{name}">', _text(column), "</Col>"]


# -- XML -------------------------------------------------------------------------------


def _order_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select(
        "o_custkey",
        "o_orderkey",
        "o_orderstatus",
        F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_orderpriority"),
    )
    return build_xml_envelope(
        orders,
        keys=["o_custkey"],
        dataset="ds_orders",
        columns=["o_orderkey", "o_orderstatus", "o_orderpriority"],
        order=["o_orderkey"],
        parameters={"ErrorCode": "0", "customer": F.col("o_custkey").cast("string")},
    )


@golden(
    "xml_envelope_parse",
    """SELECT o_custkey, true AS readable, CAST(2 AS INTEGER) AS n_parameters, CAST(1 AS INTEGER) AS n_datasets,
              CAST(count(*) AS INTEGER) AS n_rows
       FROM orders GROUP BY o_custkey""",
)
def xml_envelope_parse(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_xml_envelope(_order_envelopes(spark, sf))
    counted = parsed.select(
        "o_custkey",
        "envelope.readable",
        F.size("envelope.Parameters.Parameter").alias("n_parameters"),
        F.size("envelope.Dataset").alias("n_datasets"),
        F.size(F.get("envelope.Dataset", F.lit(0)).Rows.Row).alias("n_rows"),
    )
    # A customer with very many orders has several parts; their rows add up.
    return counted.groupBy("o_custkey").agg(
        F.every("readable").alias("readable"),
        F.max("n_parameters").alias("n_parameters"),
        F.max("n_datasets").alias("n_datasets"),
        F.sum("n_rows").cast("int").alias("n_rows"),
    )


@golden(
    "xml_parameters",
    """SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS error_code, s_name AS message, '' AS blank,
              CAST(NULL AS VARCHAR) AS absent, CAST(s_suppkey AS VARCHAR) AS repeated FROM supplier""",
)
def xml_parameters(spark: SparkSession, sf: str) -> DataFrame:
    bodies = load(spark, sf, "supplier").select(
        "s_suppkey",
        _xml(
            '<Root xmlns="http://example.org/dataset"><Parameters><Parameter id="ErrorCode">',
            _text("s_nationkey"),
            '</Parameter><Parameter id="ErrorMsg">',
            _text("s_name"),
            '</Parameter><Parameter id="blank"/><Parameter id="repeated">first</Parameter>',
            '<Parameter id="repeated">',
            _text("s_suppkey"),
            "</Parameter></Parameters></Root>",
        ),
    )
    found = envelope_parameters(parse_xml_envelope(bodies))
    names = {"error_code": "ErrorCode", "message": "ErrorMsg", "blank": "blank", "absent": "gone", "repeated": "repeated"}
    return found.select(
        "s_suppkey", *[F.try_element_at("parameters", F.lit(n)).alias(out) for out, n in names.items()]
    )


@golden(
    "xml_dataset_rows",
    """SELECT p_partkey, CAST(r AS INTEGER) AS row_no,
              CASE WHEN r < 2 THEN CAST(p_partkey AS VARCHAR) END AS id,
              CASE r WHEN 0 THEN p_name WHEN 1 THEN '' END AS name,
              CASE r WHEN 0 THEN '  ' || p_brand || ' ' END AS brand,
              CAST(NULL AS VARCHAR) AS undeclared
       FROM part, (VALUES (0), (1), (2)) v(r)""",
)
def xml_dataset_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Declared cells only, blanks, absent cells, kept spaces, an empty row, a repeated dataset."""
    bodies = load(spark, sf, "part").select(
        "p_partkey",
        _xml(
            '<Root><Dataset id="ds_part"><Rows><Row><Col id="id">old</Col></Row></Rows></Dataset>',
            '<Dataset id="ds_part"><ColumnInfo><Column id="id" type="INT"/><Column id="name" type="STRING"/>',
            '<Column id="brand" type="STRING"/></ColumnInfo><Rows><Row>',
            *_cell("id", "p_partkey"),
            *_cell("name", "p_name"),
            '<Col id="brand">  ',
            _text("p_brand"),
            ' </Col><Col id="undeclared">x</Col></Row><Row>',
            *_cell("id", "p_partkey"),
            '<Col id="name"></Col></Row><Row/></Rows></Dataset></Root>',
        ),
    )
    parsed = parse_xml_envelope(bodies)
    return envelope_rows(parsed, "ds_part", ["id", "name", "brand", "undeclared"], keep=["p_partkey"])


@golden(
    "xml_any_depth",
    """SELECT s_suppkey, s_name AS message, v.dataset, CAST(v.n AS INTEGER) AS n_rows,
              CASE v.dataset WHEN 'ds_top' THEN s_name WHEN 'ds_low' THEN CAST(s_nationkey AS VARCHAR) ELSE '<Dataset id="ds_none">' || s_suppkey END AS last
       FROM supplier, (VALUES ('ds_top', 1), ('ds_mid', 2), ('ds_low', 1)) v(dataset, n)""",
)
def xml_any_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Datasets at three depths beside parameters of the root, with comments and CDATA that hold tags."""
    bodies = load(spark, sf, "supplier").select(
        "s_suppkey",
        _xml(
            '<Root><Parameters><Parameter id="ErrorMsg">',
            _text("s_name"),
            '</Parameter></Parameters><!-- <Dataset id="ds_none"/> --><Dataset id="ds_top"><Rows><Row>',
            *_cell("v", "s_name"),
            '</Row></Rows></Dataset><Body><Dataset id="ds_mid"><Rows><Row/><Row><Col id="v"><![CDATA[<Dataset id="ds_none">',
            _text("s_suppkey"),
            ']]></Col></Row></Rows></Dataset><Page><Part><Dataset id="ds_low"><Block><Rows><Row>',
            *_cell("v", "s_nationkey"),
            "</Row></Rows></Block></Dataset></Part></Page></Body></Root>",
        ),
    )
    parsed = envelope_parameters(parse_xml_envelope(bodies))
    sets = parsed.select("s_suppkey", F.try_element_at("parameters", F.lit("ErrorMsg")).alias("message"), F.explode("envelope.Dataset").alias("d"))
    last = F.try_element_at(F.col("d.Rows.Row"), F.lit(-1)).getField("Col")
    return sets.select("s_suppkey", "message", F.col("d._id").alias("dataset"), F.size("d.Rows.Row").alias("n_rows"), F.try_element_at(last, F.lit(-1)).getField("_VALUE").alias("last"))


@golden(
    "xml_primary_dataset",
    """SELECT c_custkey, c_name AS name FROM customer""",
)
def xml_primary_dataset(spark: SparkSession, sf: str) -> DataFrame:
    bodies = load(spark, sf, "customer").select(
        "c_custkey",
        _xml(
            "<Root><Dataset><Rows><Row>",
            *_cell("name", "c_name"),
            '</Row></Rows></Dataset><Dataset id="ds_other"><Rows><Row>',
            *_cell("name", "c_mktsegment"),
            "</Row></Rows></Dataset></Root>",
        ),
    )
    return envelope_rows(parse_xml_envelope(bodies), None, ["name"], keep=["c_custkey"]).drop("row_no")


_PRODUCT_COLUMNS = {
    "names": ["product_id", "product_name", "brand"],
    "stock": ["product_id", "stock_quantity"],
    "prices": ["product_id", "sale_price"],
}


def product_responses(spark: SparkSession, sf: str) -> DataFrame:
    """One detail response per part with three datasets; large parts lack the pricing rows."""

    def dataset(name: str, *cells: list[str | Column]) -> list[str | Column]:
        flat = [piece for cell in cells for piece in cell]
        return [f'<Dataset id="{name}"><Rows><Row>', *flat, "</Row></Rows></Dataset>"]

    key = _cell("product_id", "p_partkey")
    pricing = F.when(
        F.col("p_size") <= 40, _xml(*dataset("prices", key, _cell("sale_price", "p_size")))
    ).otherwise(F.lit('<Dataset id="prices"/>'))
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.lit(200).alias("status_code"),
        _xml(
            '<Root><Parameters><Parameter id="ErrorCode">0</Parameter></Parameters>',
            *dataset("names", key, _cell("product_name", "p_name"), _cell("brand", "p_brand")),
            *dataset("stock", key, _cell("stock_quantity", "p_size")),
            pricing,
            "</Root>",
        ),
    )


@golden(
    "xml_multi_dataset_join",
    """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_brand AS brand,
              CAST(p_size AS VARCHAR) AS stock_quantity,
              CASE WHEN p_size <= 40 THEN CAST(p_size AS VARCHAR) END AS sale_price
       FROM part""",
)
def xml_multi_dataset_join(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_xml_envelope(product_responses(spark, sf).withColumnRenamed("product_id", "request"))
    return datasets_join(parsed, _PRODUCT_COLUMNS, on=["product_id"], request=["request"]).drop("request")


@golden(
    "xml_envelope_roundtrip",
    """SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
              coalesce(nullif(o_orderpriority, '1-URGENT'), '') AS o_orderpriority
       FROM orders""",
)
def xml_envelope_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_xml_envelope(_order_envelopes(spark, sf))
    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    return envelope_rows(parsed, "ds_orders", columns, keep=["o_custkey"]).drop("row_no")


# -- JSON ------------------------------------------------------------------------------


@golden(
    "json_records",
    """SELECT c_custkey, CAST(r AS INTEGER) AS row_no,
              CASE r WHEN 0 THEN c_name ELSE 'second' END AS name,
              CASE WHEN r = 0 THEN c_nationkey END AS nation
       FROM customer, (VALUES (0), (1)) v(r)
       WHERE (r = 0 AND c_mktsegment <> 'MACHINERY')
          OR (r = 1 AND c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE'))""",
)
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A list, a list under ``data``, ``data`` no list but ``items`` one, an object, an empty list."""
    record = F.concat(F.lit('{"name":"'), "c_name", F.lit('","nation":'), _text("c_nationkey"), F.lit("}"))
    both = F.concat(F.lit("["), record, F.lit(',{"name":"second"}]'))
    segment = F.col("c_mktsegment")
    body = (
        F.when(segment == "AUTOMOBILE", both)
        .when(segment == "BUILDING", F.concat(F.lit('{"total":2,"data":'), both, F.lit("}")))
        .when(segment == "FURNITURE", F.concat(F.lit('{"data":{"x":1},"items":'), both, F.lit("}")))
        .when(segment == "HOUSEHOLD", record)
        .otherwise(F.lit('{"data":[],"items":[{"name":"never"}]}'))
    )
    bodies = load(spark, sf, "customer").select("c_custkey", body.alias("body"))
    return json_records(parse_json(bodies), {"name": "string", "nation": "int"}, keep=["c_custkey"])


@golden(
    "json_request_build",
    """SELECT o_orderkey, '{"customer":' || CAST(o_custkey AS VARCHAR) || ',"filter":[{"status":"'
              || o_orderstatus || '","priority":' ||
              CASE WHEN o_orderpriority = '1-URGENT' THEN 'null' ELSE '"' || o_orderpriority || '"' END
              || '}]}' AS request
       FROM orders""",
)
def json_request_build(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")
    rows = F.array(
        F.struct(
            F.col("o_orderstatus").alias("status"),
            F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"),
        )
    )
    return build_json_request(
        orders, {"customer": F.col("o_custkey"), "filter": F.lit("replaced")}, {"filter": rows}, keep=["o_orderkey"]
    )


# -- outcomes --------------------------------------------------------------------------


def xml_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Order responses: a status per order status, a code per priority, some bodies cut short."""
    code = (
        F.when(F.col("o_orderpriority") == "1-URGENT", '<Parameter id="ErrorCode">0</Parameter>')
        .when(
            F.col("o_orderpriority") == "2-HIGH",
            '<Parameter id="ErrorCode">-404</Parameter><Parameter id="ErrorMsg">Not found</Parameter>',
        )
        .when(F.col("o_orderpriority") == "3-MEDIUM", '<Parameter id="ErrorCode">oops</Parameter>')
        .when(F.col("o_orderpriority") == "5-LOW", '<Parameter id="ErrorCode"> 0 </Parameter>')
        .otherwise("")
    )
    return load(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 201).otherwise(500).alias(
            "status_code"
        ),
        F.when(F.col("o_totalprice") < 20000, F.lit("<Root><Param"))
        .otherwise(_xml("<Root><Parameters>", code, "</Parameters></Root>"))
        .alias("body"),
    )


_XML_OUTCOME_SQL = """
    SELECT o_orderkey, status_code, outcome,
           CASE outcome WHEN 'transport' THEN CAST(status_code AS VARCHAR)
                        WHEN 'business' THEN CASE o_orderpriority WHEN '2-HIGH' THEN '-404' ELSE '-1' END
           END AS err_code,
           CASE outcome WHEN 'business' THEN
                CASE o_orderpriority WHEN '2-HIGH' THEN 'Not found' ELSE 'Unknown error' END END AS err_msg
    FROM (SELECT *, CASE WHEN status_code <> 200 OR o_totalprice < 20000 THEN 'transport'
                         WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'business'
                         ELSE 'ok' END AS outcome
          FROM (SELECT *, CAST(CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 201 ELSE 500 END AS INTEGER)
                            AS status_code FROM orders))"""


@golden("xml_business_errors", _XML_OUTCOME_SQL)
def xml_business_errors(spark: SparkSession, sf: str) -> DataFrame:
    return tag_xml(parse_xml_envelope(xml_responses(spark, sf))).drop("body", "envelope")


@golden(
    "transport_errors",
    f"""SELECT status_code, count(*) AS n_responses, sum(CASE outcome WHEN 'transport' THEN 1 ELSE 0 END)::BIGINT AS n_xml,
               sum(CASE WHEN status_code NOT IN (200, 201) THEN 1 ELSE 0 END)::BIGINT AS n_json
        FROM ({_XML_OUTCOME_SQL}) GROUP BY status_code""",
)
def transport_errors(spark: SparkSession, sf: str) -> DataFrame:
    responses = xml_responses(spark, sf)
    xml = tag_xml(parse_xml_envelope(responses)).select(
        "status_code", F.col("outcome").alias("xml_outcome"), F.lit(None).cast("string").alias("json_outcome")
    )
    json = tag_json(parse_json(responses.withColumn("body", F.lit("{}")))).select(
        "status_code", F.lit(None).cast("string").alias("xml_outcome"), F.col("outcome").alias("json_outcome")
    )
    return (
        xml.unionByName(json)
        .groupBy("status_code")
        .agg(
            F.count("xml_outcome").alias("n_responses"),
            F.count_if(F.col("xml_outcome") == "transport").alias("n_xml"),
            F.count_if(F.col("json_outcome") == "transport").alias("n_json"),
        )
    )


_JSON_CODES = {
    "1-URGENT": '{"code":200}',
    "2-HIGH": '{"code":"200","message":"text code"}',
    "3-MEDIUM": '{"code":null}',
    "4-NOT SPECIFIED": '{"code":404,"message":"gone"}',
    "5-LOW": '{"code":200.0,"message":"fine"}',
}


def json_responses(spark: SparkSession, sf: str) -> DataFrame:
    body = F.when(F.col("o_orderstatus") == "P", F.lit('[{"code":1}]')).when(
        F.col("o_totalprice") < 20000, F.lit("{not json")
    )
    for priority, text in _JSON_CODES.items():
        body = body.when(F.col("o_orderpriority") == priority, F.lit(text))
    return load(spark, sf, "orders").select(
        "o_orderkey", F.lit(200).alias("status_code"), body.otherwise(F.lit("{}")).alias("body")
    )


@golden(
    "json_business_errors",
    """
    SELECT o_orderkey, outcome,
           CASE outcome WHEN 'transport' THEN '200' WHEN 'business' THEN
             CASE o_orderpriority WHEN '2-HIGH' THEN '200' WHEN '4-NOT SPECIFIED' THEN '404' END END AS err_code,
           CASE outcome WHEN 'business' THEN
             CASE o_orderpriority WHEN '2-HIGH' THEN 'text code' WHEN '4-NOT SPECIFIED' THEN 'gone'
                                  ELSE 'Unknown error' END END AS err_msg
    FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'ok' WHEN o_totalprice < 20000 THEN 'transport'
                         WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') THEN 'business'
                         ELSE 'ok' END AS outcome FROM orders)""",
)
def json_business_errors(spark: SparkSession, sf: str) -> DataFrame:
    return tag_json(parse_json(json_responses(spark, sf))).select("o_orderkey", "outcome", "err_code", "err_msg")


@golden(
    "error_split",
    f"""SELECT o_orderkey, CASE WHEN outcome = 'ok' THEN 'ok' ELSE 'errors' END AS side, outcome
        FROM ({_XML_OUTCOME_SQL})""",
)
def error_split(spark: SparkSession, sf: str) -> DataFrame:
    split = split_errors(tag_xml(parse_xml_envelope(xml_responses(spark, sf))), "skip_row")
    ok = split.ok.select("o_orderkey", F.lit("ok").alias("side"), "outcome")
    return ok.unionByName(split.errors.select("o_orderkey", F.lit("errors").alias("side"), "outcome"))


@golden(
    "xml_request_build",
    """SELECT c_custkey, true AS readable, c_name AS name, CAST(c_custkey AS VARCHAR) AS id FROM customer""",
)
def xml_request_build(spark: SparkSession, sf: str) -> DataFrame:
    requests = build_parameters_envelope(
        load(spark, sf, "customer"), ["c_custkey"], {"name": F.col("c_name"), "id": F.col("c_custkey")}
    )
    found = envelope_parameters(parse_xml_envelope(requests))
    return found.select(
        "c_custkey", "envelope.readable", F.col("parameters")["name"].alias("name"), F.col("parameters")["id"].alias("id")
    )
