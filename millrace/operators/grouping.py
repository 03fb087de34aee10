"""``group_by``: grouped aggregates named ``<column>_<function>``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.context import RunContext
from millrace.errors import PipelineError
from millrace.registry import OPERATORS

AGGREGATES = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}


@OPERATORS.register("group_by")
def group_by(df: DataFrame, params: dict, ctx: RunContext) -> DataFrame:
    """``by``: column or columns. ``agg``: column -> function, or a list of functions.

    Every function here is combined inside each map task before the shuffle.
    """
    by = params["by"]
    by = [by] if isinstance(by, str) else list(by)
    outputs = []
    for column, wanted in params["agg"].items():
        for name in [wanted] if isinstance(wanted, str) else wanted:
            key = name.lower()
            if key not in AGGREGATES:
                raise PipelineError(f"group_by does not know the function '{name}'")
            outputs.append(AGGREGATES[key](F.col(f"`{column}`")).alias(f"{column}_{key}"))
    return df.groupBy(*[F.col(f"`{b}`") for b in by]).agg(*outputs)
