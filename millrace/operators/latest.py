"""Keep one row per key."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.context import RunContext
from millrace.registry import OPERATORS

_ORDER_ITEM = re.compile(
    r"^\s*(?P<expr>.+?)(?:\s+(?P<way>asc|desc))?(?:\s+nulls\s+(?P<nulls>first|last))?\s*$", re.IGNORECASE
)
_ORDER_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|.", re.DOTALL)


def _items(order_by: str) -> list[str]:
    """Cut at commas outside parentheses and quotes."""
    items, depth = [""], 0
    for token in _ORDER_TOKEN.findall(order_by):
        depth += (token in "([") - (token in ")]")
        if token == "," and depth == 0:
            items.append("")
        else:
            items[-1] += token
    return items


def order_columns(order_by: str | Sequence[str | Column]) -> list[Column]:
    """Sort columns from ``"a DESC, b"``. NULLs come last either way unless said otherwise."""
    items = _items(order_by) if isinstance(order_by, str) else order_by
    columns = []
    for item in items:
        if isinstance(item, Column):
            columns.append(item)
            continue
        part = _ORDER_ITEM.match(item)
        column = F.expr(part["expr"])
        descending = (part["way"] or "asc").lower() == "desc"
        nulls_first = (part["nulls"] or "last").lower() == "first"
        if descending:
            columns.append(column.desc_nulls_first() if nulls_first else column.desc_nulls_last())
        else:
            columns.append(column.asc_nulls_first() if nulls_first else column.asc_nulls_last())
    return columns


def _hashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return _hashable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_hashable(f.dataType) for f in dtype.fields)
    return True


def row_digest(df: DataFrame) -> Column:
    """A hash over the row's values: a tie-break that does not change when a task is rerun."""
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)]
    return F.xxhash64(*columns) if columns else F.lit(0)


def keep_latest(df: DataFrame, keys: Sequence[str], order_by: str | Sequence[str | Column]) -> DataFrame:
    """The first row per key in the given order.

    ``row_number() = 1`` makes Spark prune each map task to one row per key before the
    shuffle, so a key holding most of the rows sends only one row per task.
    """
    order = [*order_columns(order_by), row_digest(df).asc()]
    window = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).filter("__rank = 1").drop("__rank")


@OPERATORS.register("deduplicate")
def deduplicate(df: DataFrame, params: dict, ctx: RunContext) -> DataFrame:
    """One row per ``subset`` key: the first by ``order_by``, or any row when none is given."""
    subset = params.get("subset") or df.columns
    subset = [subset] if isinstance(subset, str) else list(subset)
    if params.get("order_by"):
        return keep_latest(df, subset, params["order_by"])
    return df.dropDuplicates(subset)
