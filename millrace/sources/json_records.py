"""JSON responses as rows, and JSON requests from rows."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The keys under which an object may hold its list of records.
RECORD_KEYS = ("data", "items", "results", "records")
PAYLOAD = "payload"


def parse_json(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``payload variant``; NULL where the body is not JSON.

    The one-element array keeps later filters and columns from parsing the body again.
    """
    return df.select("*", F.explode(F.array(F.try_parse_json(F.col(body)))).alias(PAYLOAD))


def _is_object() -> Column:
    return F.schema_of_variant(PAYLOAD).startswith("OBJECT")


def member(name: str) -> str:
    """The path to a member whose name may hold dots, brackets or one kind of quote."""
    quote = '"' if "'" in name else "'"
    return f"$[{quote}{name}{quote}]"


def json_records(df: DataFrame, columns: Mapping[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per record: a list's elements, the first listed key holding a list, or the object.

    ``columns`` maps record fields to Spark types; a field of another type gives NULL.
    Without it the record stays a ``record variant``.
    """
    lists = [F.try_variant_get(PAYLOAD, "$", "array<variant>")]
    lists += [F.try_variant_get(PAYLOAD, f"$.{key}", "array<variant>") for key in RECORD_KEYS]
    records = F.coalesce(*lists, F.when(_is_object(), F.array(F.col(PAYLOAD))))
    rows = df.select(*keep, F.posexplode(records).alias("row_no", "record"))
    if columns is None:
        return rows
    fields = [F.try_variant_get("record", member(name), kind).alias(name) for name, kind in columns.items()]
    return rows.select(*keep, "row_no", *fields)


def discover_fields(df: DataFrame) -> dict[str, str] | None:
    """Fields of all records and their types, by name; one aggregate finds them.

    Fields of several types, objects and lists are text. None when no record is an object.
    """
    shape = json_records(df).agg(F.schema_of_variant_agg("record")).first()[0]
    struct = re.sub(r"`[^`]*`|\bOBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], shape or "")
    if not struct.startswith("STRUCT<"):
        return None
    plain = (T.LongType, T.BooleanType, T.DoubleType, T.DecimalType)
    fields = T.DataType.fromDDL(struct).fields
    return {f.name: f.dataType.simpleString() if isinstance(f.dataType, plain) else "string" for f in fields} or None


def build_json_request(
    df: DataFrame,
    parameters: Mapping[str, Column],
    datasets: Mapping[str, Column],
    keep: Sequence[str] = (),
    name: str = "request",
) -> DataFrame:
    """A JSON object per row from parameters and datasets; a dataset wins a shared name."""
    fields = {**parameters, **datasets}
    body = F.to_json(F.struct(*[column.alias(key) for key, column in fields.items()]), {"ignoreNullFields": "false"})
    return df.select(*keep, body.alias(name))
