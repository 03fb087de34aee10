"""Run a golden query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _kind(value) -> str:
    return type(value).__name__


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    at = [df.columns.index(n) for n in names]
    return names, [tuple(_plain(row[i]) for i in at) for row in df.collect()]


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, [tuple(_plain(row[i]) for i in at) for row in result.fetchall()]


def difference(spark_side, duck_side) -> str | None:
    """None when both sides hold the same rows with the same Python types."""
    (names, rows), (expected_names, expected) = spark_side, duck_side
    if names != expected_names:
        return f"columns {names} instead of {expected_names}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows instead of {len(expected)}"
    for i, name in enumerate(names):
        kinds = {_kind(r[i]) for r in rows if r[i] is not None}
        wanted = {_kind(r[i]) for r in expected if r[i] is not None}
        if kinds != wanted:
            return f"column {name} is {kinds} instead of {wanted}"
    extra, lacking = Counter(rows) - Counter(expected), Counter(expected) - Counter(rows)
    if extra or lacking:
        return f"extra {list(extra)[:3]}, lacking {list(lacking)[:3]} of {names}"
    return None
