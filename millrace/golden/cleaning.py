"""Golden queries of the named table operators."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import ACCENTS, normalize_text
from millrace.golden.catalog import context, fresh_folder, golden, load
from millrace.operators.cleaning import add_date_column, drop_empty_rows, handle_nulls
from millrace.operators.filters import apply_filters, optional_search
from millrace.operators.grouping import group_by
from millrace.operators.latest import deduplicate, keep_latest
from millrace.operators.python_fn import python_script
from millrace.plans.history import History
from millrace.registry import OPERATORS
from millrace.sources.spreadsheet import scan_spreadsheets

# Every character Python counts as whitespace, as a class body for RE2.
SPACE = r"\t\n\v\f\r\x1c-\x1f \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ACCENTED = "".join(ACCENTS.values())
PLAIN = "".join(plain * len(accented) for plain, accented in ACCENTS.items())


# -- spreadsheets and headers --------------------------------------------------------


def _workbook(frame: pd.DataFrame) -> bytes:
    """A one-sheet workbook: header and text cells inline, numbers as numbers, dates as styled numbers of days."""

    def cell(value) -> str:
        if isinstance(value, pd.Timestamp):
            return f'<c s="1"><v>{(value - pd.Timestamp("1899-12-30")) / pd.Timedelta(days=1)!r}</v></c>'
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
        return f"<c><v>{value!r}</v></c>"

    lines = [list(frame.columns), *frame.itertuples(index=False, name=None)]
    rows = "".join("<row>" + "".join(cell(v) for v in line) + "</row>" for line in lines)
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><sheets>'
        '<sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/'
        f'relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/>'
        "</Relationships>",
        "xl/styles.xml": f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>",
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return buffer.getvalue()


def _workbooks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        named = frame.rename(columns=dict(zip(frame.columns, ["  Cust Key ", "Tên Khách", "Acct-Bal ($)", "Segment"])))
        named = named.astype({"  Cust Key ": object, "Acct-Bal ($)": object})
        named["Segment"] = "\t " + named["Segment"] + " \n"
        named["  Cust Key "] = [int(v) for v in frame.iloc[:, 0]]
        named["Acct-Bal ($)"] = [float(v) for v in frame.iloc[:, 2]]
        yield pd.DataFrame({"path": [f"book-{frame.iloc[0, 0]}"], "content": [_workbook(named)]})


@golden(
    "spreadsheet_scan",
    "SELECT c_custkey AS cust_key, c_name AS ten_khach, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer",
)
def spreadsheet_scan(spark: SparkSession, sf: str) -> DataFrame:
    customers = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    books = customers.mapInPandas(_workbooks, "path string, content binary")
    rows = scan_spreadsheets(books, ["cust_key", "ten_khach", "acctbal_", "segment"])
    return rows.select(
        F.col("cust_key").cast("bigint").alias("cust_key"),
        "ten_khach",
        F.col("acctbal_").cast("double").alias("acctbal"),
        "segment",
    )


@golden(
    "spreadsheet_dates",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ordered FROM orders",
)
def spreadsheet_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that are numbers styled as dates."""

    def books(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": [f"book-{frame.iloc[0, 0]}"], "content": [_workbook(frame.astype(object))]})

    orders = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz"))
    rows = scan_spreadsheets(orders.mapInPandas(books, "path string, content binary"), ["o_orderkey", "o_orderdate"])
    return rows.select(F.col("o_orderkey").cast("bigint"), F.col("o_orderdate").alias("ordered"))


@golden(
    "header_standardize",
    "SELECT p_partkey AS part_key, p_name AS ten_san_pham, p_brand AS ten_san_pham_2, p_type AS loai,"
    " p_size AS size_cm, p_retailprice AS col_unnamed FROM part",
)
def header_standardize(spark: SparkSession, sf: str) -> DataFrame:
    titled = load(spark, sf, "part").toDF(
        " Part  Key ", "Tên Sản Phẩm", "tên sản phẩm!", "Loại", "Size (cm)", "  "
    )
    return OPERATORS.get("standardize_headers")(titled, {}, None)


@golden(
    "text_normalize",
    rf"""
    WITH folded AS (
      SELECT doc_id, translate(lower(regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')),
                               '{ACCENTED}', '{PLAIN}') AS t
      FROM documents),
    snake AS (
      SELECT doc_id, regexp_replace(regexp_replace(t, '[^\p{{L}}\p{{N}}_{SPACE}]', '', 'g'),
                                    '[{SPACE}]+', '_', 'g') AS s
      FROM folded)
    SELECT doc_id, CASE WHEN s = '' THEN 'col_unnamed' ELSE s END AS normalized FROM snake
    """,
)
def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", normalize_text(F.col("text")).alias("normalized"))


@golden(
    "trim_strings",
    rf"""
    SELECT doc_id, regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS text, lang, source, n_chars
    FROM documents
    """,
)
def trim_strings(spark: SparkSession, sf: str) -> DataFrame:
    padded = load(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("\t\n "), "text", F.lit("\r\n ")).alias("text"),
        F.concat(F.lit("  "), "lang").alias("lang"),
        F.concat("source", F.lit(" \n")).alias("source"),
        "n_chars",
    )
    return OPERATORS.get("trim_strings")(padded, {}, None)


_HOLED_EVENTS_SQL = """
    SELECT nullif(event_type, 'click') AS event_type,
           CASE WHEN value >= 50 THEN value END AS value
    FROM events"""


def _holed_events(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return load(spark, sf, "events").select(
        *more,
        F.nullif("event_type", F.lit("click")).alias("event_type"),
        F.when(F.col("value") >= 50, F.col("value")).alias("value"),
    )


@golden(
    "drop_empty_rows",
    f"SELECT * FROM ({_HOLED_EVENTS_SQL}) WHERE event_type IS NOT NULL OR value IS NOT NULL",
)
def drop_empty(spark: SparkSession, sf: str) -> DataFrame:
    return drop_empty_rows(_holed_events(spark, sf))


@golden(
    "handle_nulls_any",
    """SELECT event_id, event_type, value FROM events WHERE event_type <> 'click' AND value >= 50""",
)
def handle_nulls_any(spark: SparkSession, sf: str) -> DataFrame:
    return handle_nulls(_holed_events(spark, sf, "event_id"), {"action": "drop"}, None)


@golden(
    "handle_nulls_subset",
    """SELECT event_id, nullif(event_type, 'click') AS event_type, value FROM events WHERE value >= 50""",
)
def handle_nulls_subset(spark: SparkSession, sf: str) -> DataFrame:
    return handle_nulls(_holed_events(spark, sf, "event_id"), {"strategy": "drop", "subset": ["value"]}, None)


# -- grouping, stamping, deduplication -------------------------------------------------


@golden(
    "group_by_single",
    """SELECT l_returnflag, sum(l_quantity) AS l_quantity_sum, avg(l_quantity) AS l_quantity_avg,
              count(l_quantity) AS l_quantity_count, min(l_quantity) AS l_quantity_min,
              max(l_quantity) AS l_quantity_max
       FROM lineitem GROUP BY l_returnflag""",
)
def group_by_single(spark: SparkSession, sf: str) -> DataFrame:
    return group_by(
        load(spark, sf, "lineitem"),
        {"by": "l_returnflag", "agg": {"l_quantity": ["SUM", "AVG", "COUNT", "MIN", "MAX"]}},
        None,
    )


@golden(
    "group_by_multi",
    """SELECT l_suppkey, l_linestatus, sum(l_quantity) AS l_quantity_sum, max(l_extendedprice) AS l_extendedprice_max
       FROM lineitem GROUP BY l_suppkey, l_linestatus""",
)
def group_by_multi(spark: SparkSession, sf: str) -> DataFrame:
    return group_by(
        load(spark, sf, "lineitem"),
        {"by": ["l_suppkey", "l_linestatus"], "agg": {"l_quantity": "SUM", "l_extendedprice": "MAX"}},
        None,
    )


@golden(
    "add_date_column",
    """SELECT o_orderkey, o_orderdate AS created_date, TIMESTAMP '2024-06-01 12:00:00' AS loaded_at FROM orders""",
)
def add_date(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    dated = add_date_column(orders, {"target_column": "created_date", "date_source": "o_orderdate"}, None)
    loaded = add_date_column(
        dated, {"target_column": "loaded_at", "date_source": "2024-06-01 12:00:00"}, None
    )
    return loaded.drop("o_orderdate")


_LATEST_EVENT_SQL = """
    SELECT event_id, user_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn = 1"""


@golden("deduplicate", _LATEST_EVENT_SQL)
def dedup(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return deduplicate(events, {"subset": ["user_id"], "order_by": "ts DESC, event_id DESC"}, None).drop("ts")


@golden(
    "qualify_latest",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey,
                                  l_linenumber, l_suppkey, l_quantity) = 1""",
)
def qualify_latest(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    return keep_latest(lines, ["l_partkey"], "l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_quantity")


# -- history ---------------------------------------------------------------------------


@golden("accumulate_upsert", _LATEST_EVENT_SQL)
def accumulate_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches in an order that is not the order of time, then one of them again."""
    events = load(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    ctx = context(spark, sf, history_root=fresh_folder(spark))
    params = {
        "target_history_table": "latest_event",
        "dedup_keys": ["user_id"],
        "order_by": "ts DESC, event_id DESC",
    }
    day = F.to_date("ts")
    result = None
    for batch_id, batch in (
        ("b", events.filter((day >= "2024-01-11") & (day < "2024-01-21"))),
        ("c", events.filter(day >= "2024-01-21")),
        ("a", events.filter(day < "2024-01-11")),
        ("c", events.filter(day >= "2024-01-21")),
    ):
        result = OPERATORS.get("accumulate_data")(batch, {**params, "batch_id": batch_id}, ctx)
    return result.drop("ts")


@golden(
    "accumulate_schema_evolution",
    """SELECT o_custkey, o_orderkey,
              CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_orderpriority END AS o_orderpriority
       FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
)
def accumulate_schema_evolution(spark: SparkSession, sf: str) -> DataFrame:
    """The second batch brings a column; rows kept from the first have NULL in it."""
    orders = load(spark, sf, "orders")
    cut = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    history = History(
        spark, f"{fresh_folder(spark)}/orders", keys=["o_custkey"], order_by="o_orderkey DESC", buckets=8
    )
    history.merge(orders.filter(~cut).select("o_custkey", "o_orderkey"))
    history.merge(orders.filter(cut).select("o_custkey", "o_orderkey", "o_orderpriority"))
    return history.read()


# -- Python ----------------------------------------------------------------------------


@golden(
    "python_transform",
    """SELECT doc_id, length(text) AS n_text, n_chars - length(text) AS n_diff FROM documents""",
)
def python_transform(spark: SparkSession, sf: str) -> DataFrame:
    def measure(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame["text"].str.len()
        return pd.DataFrame({"doc_id": frame["doc_id"], "n_text": sizes, "n_diff": frame["n_chars"] - sizes})

    docs = load(spark, sf, "documents").select("doc_id", "text", "n_chars")
    return python_script(
        docs, {"function": measure, "schema": "doc_id bigint, n_text bigint, n_diff bigint"}, None
    )


@golden(
    "python_group_transform",
    """SELECT user_id, count(*) AS n, min(value) AS low, max(value) AS high,
              CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
       FROM events GROUP BY user_id""",
)
def python_group_transform(spark: SparkSession, sf: str) -> DataFrame:
    def partial(frame: pd.DataFrame) -> pd.DataFrame:
        cents = (frame["value"] * 100).round().astype("int64")
        return pd.DataFrame(
            {"user_id": frame["user_id"], "n": 1, "low": frame["value"], "high": frame["value"], "cents": cents}
        )

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        folded = frame.groupby("user_id", dropna=False, sort=False)
        return folded.agg({"n": "sum", "low": "min", "high": "max", "cents": "sum"}).reset_index()

    events = load(spark, sf, "events").select("user_id", "value")
    schema = "user_id bigint, n bigint, low double, high double, cents bigint"
    return python_script(
        events, {"function": partial, "merge": merge, "keys": ["user_id"], "schema": schema}, None
    )


# -- filters ---------------------------------------------------------------------------


def _filter_case(name: str, table: str, columns: str, conditions: list[tuple], where: str) -> None:
    @golden(name, f"SELECT {columns} FROM {table} WHERE {where}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        given = [{"field": f, "operator": o, "value": v} for f, o, v in conditions]
        return apply_filters(load(spark, sf, table), given).selectExpr(*columns.split(", "))


_filter_case(
    "filter_compare",
    "lineitem",
    "l_orderkey, l_linenumber, l_quantity, l_extendedprice",
    [
        ("l_quantity", ">", 10),
        ("l_quantity", "<=", 40),
        ("l_linenumber", "!=", 3),
        ("l_discount", "<", 0.05),
        ("l_tax", ">=", 0.02),
        ("l_linestatus", "==", "O"),
    ],
    "l_quantity > 10 AND l_quantity <= 40 AND l_linenumber <> 3 AND l_discount < 0.05 AND l_tax >= 0.02"
    " AND l_linestatus = 'O'",
)
_filter_case(
    "filter_in",
    "customer",
    "c_custkey, c_mktsegment",
    [("c_mktsegment", "IN", ["BUILDING", "MACHINERY"])],
    "c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
_filter_case(
    "filter_not_in",
    "customer",
    "c_custkey, c_mktsegment",
    [("c_mktsegment", "NOT IN", ["BUILDING", "MACHINERY"])],
    "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
)
_filter_case(
    "filter_contains",
    "documents",
    "doc_id, source, n_chars",
    [("text", "CONTAINS", "the")],
    "contains(text, 'the')",
)
_filter_case(
    "filter_chain",
    "orders",
    "o_orderkey, o_totalprice",
    [
        ("o_orderstatus", "==", "O"),
        ("o_totalprice", ">", 100000),
        ("o_orderpriority", "IN", ["1-URGENT", "2-HIGH"]),
    ],
    "o_orderstatus = 'O' AND o_totalprice > 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
_filter_case(
    "filter_missing_column",
    "orders",
    "o_orderkey, o_totalprice",
    [("no_such_column", "==", "x"), ("o_totalprice", ">", 200000)],
    "o_totalprice > 200000",
)


@golden(
    "filter_numeric_string",
    """SELECT event_id, score FROM (
         SELECT event_id, CASE WHEN event_type = 'click' THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS score
         FROM events) WHERE TRY_CAST(score AS DOUBLE) >= 50""",
)
def filter_numeric_string(spark: SparkSession, sf: str) -> DataFrame:
    scored = load(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "click", "n/a").otherwise(F.get_json_object("props", "$.k")).alias("score"),
    )
    return apply_filters(scored, [{"field": "score", "operator": ">=", "value": 50}])


@golden(
    "optional_search",
    """SELECT p_partkey, p_brand, p_type, p_size FROM part
       WHERE p_brand = 'Brand#1' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)""",
)
def search(spark: SparkSession, sf: str) -> DataFrame:
    products = load(spark, sf, "part").select(
        "p_partkey", F.struct("p_brand", "p_type").alias("kind"), F.struct("p_size").alias("stock")
    )
    ordered = load(spark, sf, "lineitem").filter("l_quantity >= 45").select("l_partkey")
    found = optional_search(
        products, equals={"kind.p_brand": "Brand#1", "kind.p_type": "", "stock.p_size": None}, ids=("p_partkey", ordered)
    )
    return found.select("p_partkey", "kind.p_brand", "kind.p_type", "stock.p_size")
