"""Null handling, empty rows, load stamps and text trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.context import RunContext
from millrace.errors import PipelineError
from millrace.functions.text import standardize_headers, trim_strings
from millrace.registry import OPERATORS


@OPERATORS.register("handle_nulls")
def handle_nulls(df: DataFrame, params: dict, ctx: RunContext) -> DataFrame:
    """Drop rows with a NULL in ``subset`` (all columns when absent)."""
    strategy = params.get("strategy") or params.get("action") or "drop"
    if strategy != "drop":
        raise PipelineError(f"handle_nulls knows only 'drop', not '{strategy}'")
    return df.na.drop(how="any", subset=params.get("subset") or None)


@OPERATORS.register("drop_empty_rows")
def drop_empty_rows(df: DataFrame, params: dict | None = None, ctx: RunContext | None = None) -> DataFrame:
    """Drop rows in which every column is NULL."""
    return df.na.drop(how="all")


@OPERATORS.register("add_date_column")
def add_date_column(df: DataFrame, params: dict, ctx: RunContext) -> DataFrame:
    """Stamp rows with the load time, a column of the table or a given literal."""
    source = params.get("date_source", "current_timestamp")
    if source == "current_timestamp":
        stamp = F.current_timestamp()
    elif source in df.columns:
        stamp = F.col(f"`{source}`")
    else:
        stamp = F.lit(source).cast("timestamp_ntz")
    return df.withColumn(params["target_column"], stamp)


@OPERATORS.register("standardize_headers")
def standardize_headers_op(df: DataFrame, params: dict, ctx: RunContext) -> DataFrame:
    return standardize_headers(df)


@OPERATORS.register("trim_strings")
def trim_strings_op(df: DataFrame, params: dict, ctx: RunContext) -> DataFrame:
    return trim_strings(df)
