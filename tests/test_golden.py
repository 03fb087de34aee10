"""Every golden query against its SQL on DuckDB, and the shape of every plan."""

import pytest

import __spark_entry__ as entry_points
import oracle

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name not in NESTED_LOOP_OK:
        assert "NestedLoop" not in plan
    rows = oracle.spark_rows(df)
    if name in SQL:
        assert oracle.difference(rows, oracle.duck_rows(duck, SQL[name])) is None
    else:
        assert rows[1]


# No plan needs one today.
NESTED_LOOP_OK: set[str] = set()


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["c_mktsegment", "n_orders", "revenue"]
