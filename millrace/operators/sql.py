"""``sql_transform``: Spark SQL over the active table and earlier step tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.context import RunContext
from millrace.errors import PipelineError
from millrace.registry import OPERATORS

DEFAULT_QUERY = "SELECT * FROM {{ active_table }}"


@OPERATORS.register("sql_transform")
def sql_transform(df: DataFrame | None, params: dict, ctx: RunContext) -> DataFrame:
    unknown = set(params) - {"query", "args"}
    if unknown:
        raise PipelineError(f"sql_transform does not know {sorted(unknown)}")
    return ctx.sql(params.get("query", DEFAULT_QUERY), active=df, args=params.get("args"))
