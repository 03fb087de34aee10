"""Named operators: ``(DataFrame, params, RunContext) -> DataFrame``."""

from millrace.operators import accumulate, cleaning, filters, grouping, latest, python_fn, sql  # noqa: F401
