"""Path lookups: into input values on the driver, and into nested columns."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SEGMENT = re.compile(r"(?P<name>[^.\[\]]+)|\[(?P<at>\d+)\]")


def steps(path: str) -> list[str | int]:
    """``a[1].b`` as names and positions: ``["a", 1, "b"]``."""
    return [int(m["at"]) if m["at"] else m["name"] for m in _SEGMENT.finditer(path)]


def column_and_position(path: str) -> tuple[str, int | None]:
    """``a.b[2]`` as ``("a.b", 2)``; without a position at the end, the path and None."""
    name, bracket, rest = path.rpartition("[")
    return (name, int(rest[:-1])) if bracket and rest.endswith("]") and rest[:-1].isdigit() else (path, None)


def output_alias(path: str) -> str:
    """The column name a path yields: the last name on it."""
    names = [s for s in _SEGMENT.findall(path) if s[0]]
    return names[-1][0] if names else path


def nested_value(data: Any, path: str) -> Any:
    """The value at the end of a path.

    On a list, a number is a position and a name is asked of each of its records. A
    position in brackets leaves anything but a list as it is.
    """
    for step in steps(path):
        match data:
            case list() if isinstance(step, int) or step.isdigit():
                data = data[int(step)] if int(step) < len(data) else None
            case list():
                data = [record[step] for record in data if isinstance(record, dict) and step in record]
            case _ if isinstance(step, int):
                continue
            case dict():
                data = data.get(step)
            case _:
                return None
    return data


def nested_column(df: DataFrame, path: str) -> Column:
    """The same path rules over a struct, map or array column of ``df``.

    Positions outside an array and unknown map keys give NULL. An unknown struct field
    gives NULL too, as it does for a value.
    """
    head, *rest = steps(path) or [""]
    by_name = {field.name: field.dataType for field in df.schema.fields}
    if str(head) not in by_name:
        return F.lit(None)
    column, dtype = F.col(f"`{head}`"), by_name[str(head)]
    for step in rest:
        if isinstance(step, str) or isinstance(dtype, T.ArrayType):
            column, dtype = _step(column, dtype, str(step))
    return column


def _step(column: Column, dtype: T.DataType, part: str) -> tuple[Column, T.DataType]:
    if isinstance(dtype, T.StructType):
        if part in dtype.fieldNames():
            return column.getField(part), dtype[part].dataType
    elif isinstance(dtype, T.MapType):
        return F.try_element_at(column, F.lit(part)), dtype.valueType
    elif isinstance(dtype, T.ArrayType):
        if part.isdigit():
            return F.get(column, F.lit(int(part))), dtype.elementType
        inner = dtype.elementType
        if isinstance(inner, T.StructType) and part in inner.fieldNames():
            return F.transform(column, lambda x: x.getField(part)), T.ArrayType(inner[part].dataType)
        if isinstance(inner, T.MapType):
            have = F.filter(column, lambda x: F.map_contains_key(x, F.lit(part)))
            return (
                F.transform(have, lambda x: F.try_element_at(x, F.lit(part))),
                T.ArrayType(inner.valueType),
            )
    return F.lit(None), T.NullType()
