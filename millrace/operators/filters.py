"""Filter conditions given as data, and the optional-argument search."""

from __future__ import annotations

import functools
import logging
import operator
from collections.abc import Iterable, Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.context import RunContext
from millrace.errors import PipelineError
from millrace.functions.paths import nested_column
from millrace.registry import OPERATORS

log = logging.getLogger(__name__)

_COMPARE = {
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
    "==": operator.eq,
    "=": operator.eq,
    "!=": operator.ne,
}


class Condition(NamedTuple):
    field: str
    operator: str
    value: Any


def _predicate(df: DataFrame, cond: Condition) -> Column:
    column = F.col(f"`{cond.field}`")
    op = cond.operator.strip().upper()
    if op in _COMPARE:
        number = isinstance(cond.value, (int, float)) and not isinstance(cond.value, bool)
        if number and isinstance(df.schema[cond.field].dataType, T.StringType):
            column = column.try_cast("double")
        return _COMPARE[op](column, F.lit(cond.value))
    if op == "IN":
        return column.isin(list(cond.value))
    if op == "NOT IN":
        return ~column.isin(list(cond.value))
    if op == "CONTAINS":
        return F.contains(column.cast("string"), F.lit(str(cond.value)))
    raise PipelineError(f"filter does not know the operator '{cond.operator}'")


def apply_filters(df: DataFrame, conditions: Iterable[Condition | Mapping]) -> DataFrame:
    """Keep rows meeting every condition; conditions on absent columns are skipped."""
    predicates = []
    for item in conditions:
        cond = item if isinstance(item, Condition) else Condition(item["field"], item["operator"], item["value"])
        if cond.field not in df.columns:
            log.warning("filter on '%s' skipped: no such column", cond.field)
            continue
        predicates.append(_predicate(df, cond))
    return df.filter(functools.reduce(operator.and_, predicates)) if predicates else df


@OPERATORS.register("filter")
def filter_rows(df: DataFrame, params: dict, ctx: RunContext) -> DataFrame:
    return apply_filters(df, params["conditions"])


def optional_search(
    df: DataFrame,
    equals: Mapping[str, Any] | None = None,
    ids: tuple[str, Sequence[Any] | DataFrame] | None = None,
) -> DataFrame:
    """Restrict only by the arguments that are set.

    ``equals`` maps a (nested) column path to a value; an empty value restricts nothing.
    ``ids`` pairs a column with a list or a one-column table, of any size: both join as a
    table. NULL and empty ids are left out; without any other id nothing is restricted. Ids
    of another type than the column meet it as text.
    """
    for path, value in (equals or {}).items():
        if value is not None and value != "":
            df = df.filter(nested_column(df, path) == F.lit(value))
    if ids is None:
        return df
    column, wanted = ids
    if not isinstance(wanted, DataFrame):
        wanted = [w for w in wanted if w is not None and w != ""]
        if not wanted:
            return df
        if len({type(w) for w in wanted}) > 1:
            wanted = [str(w) for w in wanted]
        wanted = df.sparkSession.createDataFrame([(w,) for w in wanted], ["__id"])
    wanted = wanted.toDF("__id").filter(F.col("__id").isNotNull() & (F.col("__id").cast("string") != ""))
    if wanted.isEmpty():
        return df
    kind, own = wanted.schema["__id"].dataType, df.schema[column].dataType
    left, right = F.col(f"`{column}`"), F.col("__id")
    if kind != own and not (isinstance(kind, T.NumericType) and isinstance(own, T.NumericType)):
        left, right = left.cast("string"), right.cast("string")
    return df.join(wanted, left == right, "left_semi")
