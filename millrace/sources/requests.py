"""Request bodies from the values a step sends."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.json_records import build_json_request
from millrace.sources.steps import Request
from millrace.sources.xml_envelope import dataset_struct, envelope_document

_AT = "__sent_"


def _column(value: Any) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value])
    return F.lit(value)


def _zipped(lists: list[Column], build) -> Column:
    """Rows from lists by position, made by ``build(values)``.

    As many rows as the longest list, one at least; a list of one repeats, a shorter list
    ends in NULLs.
    """
    sizes = [F.size(c) for c in lists]
    longest = F.greatest(F.lit(1), *sizes, F.lit(1))

    def row(i: Column) -> Column:
        return build([F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.get(c, i)) for c in lists])

    return F.transform(F.sequence(F.lit(0), longest - 1), row)


def request_bodies(spark: SparkSession, step, request: Request) -> DataFrame:
    """``body`` per driving row; everything is built within the row, without a shuffle."""
    rows = spark.range(1).select() if request.driving is None else request.driving
    kept = rows.columns
    rows = rows.select("*", *[_column(s.value).alias(f"{_AT}{i}") for i, s in enumerate(request.sent)])

    parameters: dict[str, Column] = {}
    datasets: dict[str, list[tuple[str, Column]]] = {}
    for i, sent in enumerate(request.sent):
        column = F.col(f"{_AT}{i}")
        is_list = isinstance(rows.schema[f"{_AT}{i}"].dataType, T.ArrayType)
        if sent.dataset is None:
            parameters[sent.name] = F.get(column, F.lit(0)) if is_list else column
        else:
            # An absent value is an empty list, so it does not repeat.
            one = F.when(column.isNull(), F.slice(F.array(column), 1, 0)).otherwise(F.array(column))
            datasets.setdefault(sent.dataset, []).append((sent.name, F.coalesce(column, F.array()) if is_list else one))

    if step.driver in ("json", "rest"):
        built = {
            name: _zipped(
                [c for _, c in columns],
                lambda values, columns=columns: F.struct(*[v.alias(n) for (n, _), v in zip(columns, values)]),
            )
            for name, columns in datasets.items()
        }
        return build_json_request(rows, parameters, built, keep=kept, name="body")
    built = [
        dataset_struct(name, [n for n, _ in columns], lambda cells, columns=columns: _zipped([c for _, c in columns], cells))
        for name, columns in datasets.items()
    ]
    return rows.select(*kept, envelope_document(parameters, F.array(*built) if built else None).alias("body"))
