"""Reference queries: each operator run over the given tables, with the SQL it must equal."""

from millrace.golden import cleaning, enveloped, pipelines, sql_surface, windows  # noqa: F401
from millrace.golden.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
