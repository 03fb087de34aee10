"""Registration of golden queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.context import RunContext
from millrace.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def golden(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL that gives the same rows; no SQL where none can."""

    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def context(spark: SparkSession, sf_dir: str, *names: str, **options) -> RunContext:
    ctx = RunContext(spark, **options)
    for name in names:
        ctx.register(name, load(spark, sf_dir, name))
    return ctx


def fresh_folder(spark: SparkSession) -> str:
    """A folder of its own for a query that has to write."""
    return f"{shared_folder(spark)}/millrace-golden/{uuid.uuid4().hex}"
