"""Positional reads: a column as an ordered list, and columns zipped by position."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.ordered import row_number, with_measures

_POS = "__position"


def value_at(df: DataFrame, column: str, index: int, order: Sequence[str | Column]) -> Column:
    """The value at a position of the ordered column, as a scalar subquery.

    NULL when the table is shorter. Spark keeps only ``index + 1`` rows per task.
    """
    return df.orderBy(*order).offset(index).limit(1).select(column).scalar()


class Series(NamedTuple):
    """A column of a table taken as a list in a given order."""

    df: DataFrame
    column: str
    order: Sequence[str]


def _sql_type(values: list) -> str:
    kinds = {type(v) for v in values if v is not None}
    if kinds == {bool}:
        return "boolean"
    if kinds == {int}:
        return "bigint"
    return "double" if kinds and kinds <= {int, float} else "string"


def zip_columns(spark: SparkSession, columns: dict[str, Series | list | Any]) -> DataFrame:
    """Rows built from columns side by side, by position.

    As many rows as the longest column has, and one at least. A column of one value
    repeats; a shorter column ends in NULLs. A value may be a :class:`Series`, a list
    given with the run, or a single value. No columns give no rows.
    """
    if not columns:
        return spark.createDataFrame([], "position bigint")

    tables: list[tuple[DataFrame, list[tuple[str, str]], Series]] = []
    literals: dict[str, list] = {}
    for name, value in columns.items():
        if isinstance(value, Series):
            same = [t for t in tables if t[0] is value.df and list(t[2].order) == list(value.order)]
            if same:
                same[0][1].append((name, value.column))
            else:
                tables.append((value.df, [(name, value.column)], value))
        elif isinstance(value, list):
            literals[name] = value
        else:
            literals[name] = [] if value is None else [value]

    # Lists given with the run are small; they become one table with a position column.
    longest = max([1, *[len(v) for v in literals.values()]])
    given = zip(range(longest), *[v + [None] * (longest - len(v)) for v in literals.values()])
    types = [f"{_POS} bigint", *[f"`{n}` {_sql_type(v)}" for n, v in literals.items()]]
    frames = [spark.createDataFrame(list(given), ", ".join(types))]
    repeats: dict[str, Column] = {n: F.lit(v[0]) for n, v in literals.items() if len(v) == 1}
    for df, names, series in tables:
        numbered = with_measures(df, [], series.order, {_POS: row_number()})
        frames.append(numbered.select((F.col(_POS) - 1).alias(_POS), *[F.col(c).alias(n) for n, c in names]))
        size = df.limit(2).agg(F.count(F.lit(1))).scalar()
        for name, column in names:
            only = df.limit(2).agg(F.any_value(column)).scalar()
            repeats[name] = F.when(size == 1, only)

    zipped = reduce(lambda a, b: a.join(b, _POS, "full_outer"), frames)
    return zipped.select(
        F.col(_POS).alias("position"),
        *[(F.coalesce(F.col(n), repeats[n]) if n in repeats else F.col(n)).alias(n) for n in columns],
    )
