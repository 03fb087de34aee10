import datetime as dt

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.errors import PipelineError
from millrace.functions.text import clean_header, clean_headers, normalize_text, standardize_headers
from millrace.operators.filters import Condition, apply_filters, optional_search
from millrace.operators.latest import keep_latest, order_columns
from millrace.operators.python_fn import reduce_groups
from millrace.registry import OPERATORS, Registry


def op(name, df, params, ctx=None):
    return OPERATORS.get(name)(df, params, ctx)


def values(df, column):
    return sorted(r[column] for r in df.collect())


# -- nulls, grouping, stamps, duplicates ---------------------------------------------


@pytest.fixture
def vessels(spark):
    rows = [(21, "north", None), (22, None, 3.1), (23, "south", 4.5), (24, None, None), (25, "east", 2.0)]
    return spark.createDataFrame(rows, "id int, berth string, draught double")


@pytest.mark.parametrize("params", [{"action": "drop"}, {"strategy": "drop"}, {}])
def test_nulls_in_any_column(vessels, params):
    assert values(op("handle_nulls", vessels, params), "id") == [23, 25]


def test_nulls_in_a_subset(vessels):
    assert values(op("handle_nulls", vessels, {"action": "drop", "subset": ["draught"]}), "id") == [22, 23, 25]


def test_unknown_null_strategy(vessels):
    with pytest.raises(PipelineError):
        op("handle_nulls", vessels, {"strategy": "fill"})


def test_group_by_average(spark):
    df = spark.createDataFrame([("quay", 4), ("quay", 9), ("lock", None), ("lock", 6), ("weir", None)], "site string, depth int")
    rows = {r.site: r.depth_avg for r in op("group_by", df, {"by": ["site"], "agg": {"depth": "AVG"}}).collect()}
    assert rows == {"quay": 6.5, "lock": 6.0, "weir": None}


def test_group_by_several_columns_and_functions(spark):
    df = spark.createDataFrame(
        [("quay", 1, 7), ("quay", 1, -2), ("lock", 1, 8), ("lock", 2, None), (None, 2, 5)],
        "site string, shift int, loads int",
    )
    out = op("group_by", df, {"by": ["site", "shift"], "agg": {"loads": ["SUM", "max"]}})
    assert out.columns == ["site", "shift", "loads_sum", "loads_max"]
    got = {(r.site, r.shift): (r.loads_sum, r.loads_max) for r in out.collect()}
    assert got == {("quay", 1): (5, 7), ("lock", 1): (8, 8), ("lock", 2): (None, None), (None, 2): (5, 5)}
    # A report may ask for the name in capitals.
    assert out.select("loads_SUM").count() == 4


def test_group_by_unknown_function(vessels):
    with pytest.raises(PipelineError):
        op("group_by", vessels, {"by": "id", "agg": {"berth": "MODE"}})


def test_load_stamp(spark, vessels):
    stamped = op("add_date_column", vessels, {"target_column": "created_date"})
    times = {r.created_date for r in stamped.collect()}
    assert len(times) == 1 and isinstance(times.pop(), dt.datetime)


def test_deduplicate(spark):
    df = spark.createDataFrame([("ebb", 4), ("flow", 7), ("ebb", 9), ("slack", 1), ("flow", 2)], "tide string, metres int")
    assert values(op("deduplicate", df, {"subset": ["tide"]}), "tide") == ["ebb", "flow", "slack"]
    best = op("deduplicate", df, {"subset": "tide", "order_by": "metres DESC"})
    assert values(best, "metres") == [1, 7, 9]


def test_latest_puts_nulls_last_and_groups_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, None), (1, None), (1, 5)], "k int, v int")
    for order in ("v DESC", "v", "v ASC NULLS LAST"):
        rows = {r.k: r.v for r in keep_latest(df, ["k"], order).collect()}
        assert rows == {None: 1, 1: 5}
    assert {r.k: r.v for r in keep_latest(df, ["k"], "v NULLS FIRST").collect()} == {None: None, 1: None}


def test_order_text_may_hold_expressions():
    assert len(order_columns("coalesce(a, b) DESC, c")) == 2


def test_latest_prunes_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    plan = keep_latest(df, ["k"], "v DESC")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


# -- filters -------------------------------------------------------------------------


@pytest.fixture
def sample(spark):
    return spark.createDataFrame(
        [
            (11, "oak-2", 12, False, "timber"),
            (12, "pine-7", 31, True, "timber"),
            (13, "slate", 7, True, "stone"),
            (14, "oakum", 31, True, "fibre"),
            (15, None, None, None, None),
        ],
        "id int, label string, weight int, stocked boolean, kind string",
    )


@pytest.mark.parametrize(
    "conditions, ids",
    [
        ([("weight", "<=", 12)], [11, 13]),
        ([("weight", ">", 30)], [12, 14]),
        ([("weight", "!=", 31)], [11, 13]),
        ([("kind", "IN", ["stone", "fibre"])], [13, 14]),
        ([("kind", "NOT IN", ["stone"])], [11, 12, 14]),
        ([("label", "CONTAINS", "oak")], [11, 14]),
        ([("stocked", "==", True), ("weight", "<", 40), ("kind", "!=", "stone")], [12, 14]),
        ([("colour", "==", "grey"), ("label", "==", "slate")], [13]),
        ([], [11, 12, 13, 14, 15]),
    ],
)
def test_filters(sample, conditions, ids):
    assert values(apply_filters(sample, [Condition(*c) for c in conditions]), "id") == ids


def test_number_filter_on_text(spark):
    df = spark.createDataFrame([("42",), ("95",), ("n/a",), (None,), (" 60 ",)], "score string")
    assert values(apply_filters(df, [Condition("score", ">=", 50)]), "score") == [" 60 ", "95"]


def test_optional_search(spark):
    rows = [("SP-001", "Wear", ("IN",)), ("SP-002", "Wear", ("OUT",)), ("SP-003", "Toys", ("IN",))]
    df = spark.createDataFrame(rows, "product_id string, category string, inventory struct<status: string>")
    assert values(optional_search(df, {"category": ""}, ("product_id", ["SP-001", "SP-003"])), "product_id") == [
        "SP-001",
        "SP-003",
    ]
    assert values(optional_search(df, {"category": "Wear", "inventory.status": "IN"}), "product_id") == ["SP-001"]
    assert optional_search(df, {}, ("product_id", [])).count() == 3
    many = [f"X-{i}" for i in range(500)] + ["SP-002"]
    assert values(optional_search(df, {}, ("product_id", many)), "product_id") == ["SP-002"]


# -- text ----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "title, name",
    [
        ("  Mã Sản Phẩm ", "ma_san_pham"),
        ("Giá bán (VNĐ)", "gia_ban_vnd"),
        ("a\t b\n c", "a_b_c"),
        ("!!!", "col_unnamed"),
        ("", "col_unnamed"),
        ("Stock_Qty", "stock_qty"),
    ],
)
def test_clean_header(title, name):
    assert clean_header(title) == name


def test_headers_stay_distinct(spark):
    assert clean_headers(["A", "a ", "a!", "b"]) == ["a", "a_2", "a_3", "b"]
    df = standardize_headers(spark.createDataFrame([(1, 2)], "`A x` int, `a x!` int"))
    assert df.columns == ["a_x", "a_x_2"]


# Java knows fewer letters than Python's newer Unicode, so unusual scripts are left out,
# and so is the one letter here that the two put in lower case differently.
_LETTERS = st.one_of(
    st.characters(max_codepoint=0x17F, exclude_characters="İ"),
    st.sampled_from("ạảắẵệỉộợữỵđÁỆĐ²½①漢字\u0301\u1680\u2003\u2028\u202f\u3000\u200b‿"),
)


@given(st.lists(st.text(alphabet=_LETTERS), max_size=30))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_values_normalise_like_headers(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", normalize_text(df.t).alias("n")).collect()}
    assert got == {i: clean_header(t) for i, t in enumerate(texts)}


# -- Python --------------------------------------------------------------------------


def test_python_step_gets_the_frame(spark, vessels):
    out = op("python_script", vessels, {"function": lambda df, ctx: df.filter("id > 23")})
    assert values(out, "id") == [24, 25]


def test_python_step_by_name(spark, vessels):
    from millrace.context import RunContext

    ctx = RunContext(spark, functions={"transform_data": lambda df, c: df.limit(0)})
    assert op("python_script", vessels, {}, ctx).count() == 0
    with pytest.raises(PipelineError):
        op("python_script", vessels, {"function": "gone"}, ctx)


def test_python_step_must_return_a_frame(vessels):
    with pytest.raises(PipelineError):
        op("python_script", vessels, {"function": lambda df, ctx: None})


def test_script_text_is_refused(vessels):
    with pytest.raises(PipelineError):
        op("python_script", vessels, {"script": "def transform_data(df, c): return df"})


def test_reduce_groups_with_a_hot_and_a_null_key(spark):
    df = spark.range(0, 30_000, 1, 7).selectExpr(
        "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 1 ELSE id % 50 END AS k", "id AS v"
    )

    def partial(frame):
        return pd.DataFrame({"k": frame["k"], "n": 1, "s": frame["v"]})

    def merge(frame):
        return frame.groupby("k", dropna=False, sort=False).agg({"n": "sum", "s": "sum"}).reset_index()

    out = reduce_groups(df, ["k"], partial, merge, "k bigint, n bigint, s bigint")
    got = {r.k: (r.n, r.s) for r in out.collect()}
    plain = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    want = {r.k: (r.n, r.s) for r in plain.collect()}
    assert got == want and out.count() == len(want)


# -- registry ------------------------------------------------------------------------


def test_registry():
    registry = Registry("operator")
    registry.register("a", "b")(len)
    assert registry.get("b") is len and registry.names() == ["a", "b"] and "c" not in registry
    with pytest.raises(KeyError):
        registry.get("c")
    for name in ("sql_transform", "accumulate_data", "python_script", "handle_nulls", "group_by", "add_date_column"):
        assert name in OPERATORS


def test_task_functions_need_no_installed_package(tmp_path):
    """An executor has only the pickled function, not this package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from millrace.sources.spreadsheet import _sheet_rows

    (tmp_path / "fn.pkl").write_bytes(cloudpickle.dumps(_sheet_rows))
    code = "import pickle; print(list(pickle.load(open('fn.pkl', 'rb'))(iter([]))))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "[]", done.stderr
