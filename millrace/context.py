"""Run state: step tables, inputs, session values and SQL over them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import MissingTable, PipelineError
from millrace.functions.paths import nested_value


_PLACEHOLDER = re.compile(r"\{\{\s*(.*?)\s*\}\}")
_SCHEMA_PREFIX = re.compile(r"\{\{\s*schema\s*\}\}\.(\w+)")
_TABLE_CALL = re.compile(r"""tables\(\s*['"]([^'"]+)['"]\s*\)""")
# Quoted texts, quoted names and comments: what is inside them is not code.
_SQL_QUOTED = re.compile(
    r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/)""", re.DOTALL
)


class RunContext:
    """Holds the lazy tables of one run; nothing is materialised here.

    Each table is also a temp view whose name carries the run id, so two runs in one
    session never see each other's tables.
    """

    def __init__(
        self,
        spark: SparkSession,
        run_id: str | None = None,
        inputs: dict[str, Any] | None = None,
        session: dict[str, Any] | None = None,
        responses: dict[str, DataFrame] | None = None,
        fetchers: dict[str, Callable] | None = None,
        functions: dict[str, Callable] | None = None,
        history_root: str | None = None,
    ):
        self.spark = spark
        self.run_id = run_id or uuid.uuid4().hex[:8]
        self.namespace = "ns_" + re.sub(r"[^0-9A-Za-z_]", "_", self.run_id)
        self.inputs = inputs or {}
        self.session = session or {}
        self.responses = responses or {}
        self.fetchers = fetchers or {}
        self.functions = functions or {}
        self.history_root = history_root
        self.tables: dict[str, DataFrame] = {}
        self._scratch = 0

    # -- tables -----------------------------------------------------------------

    def view_name(self, name: str) -> str:
        return f"{self.namespace}__" + re.sub(r"[^0-9A-Za-z_]", "_", name)

    def register(self, name: str, df: DataFrame) -> DataFrame:
        """Replace the step table ``name``."""
        self.tables[name] = df
        df.createOrReplaceTempView(self.view_name(name))
        return df

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise MissingTable(f"table '{name}' does not exist in run {self.run_id}")
        return self.tables[name]

    def close(self) -> None:
        for name in self.tables:
            self.spark.catalog.dropTempView(self.view_name(name))
        self.tables.clear()

    # -- values -----------------------------------------------------------------

    def value(self, path: str) -> Any:
        """An ``inputs.``/``global_input.``/``session.`` value, or None."""
        for prefix, scope in (
            ("global_input", self.inputs),
            ("input_data", self.inputs),
            ("inputs", self.inputs),
            ("session", self.session),
        ):
            if path == prefix or path.startswith(prefix + "."):
                return nested_value(scope, path[len(prefix) + 1 :])
        raise PipelineError(f"'{path}' names neither an input nor a session value")

    # -- SQL --------------------------------------------------------------------

    def sql(self, text: str, active: DataFrame | None = None, args: dict[str, Any] | None = None) -> DataFrame:
        """Run SQL over the step tables.

        ``{{ active_table }}``, ``{{ tables('x') }}`` and ``{{ schema }}.x`` become view
        names. ``{{ inputs.x }}`` and ``{{ session.x }}`` become bound parameters, never
        text, and may stand inside a quoted literal.
        """
        bound = dict(args or {})
        scratch = None
        if active is not None:
            self._scratch += 1
            scratch = f"{self.namespace}__active_{self._scratch}"
            active.createOrReplaceTempView(scratch)
        try:
            rendered = self._render(text, scratch, bound)
            return self.spark.sql(rendered, args=bound) if bound else self.spark.sql(rendered)
        finally:
            if scratch is not None:
                # The analysed plan already holds the view's plan.
                self.spark.catalog.dropTempView(scratch)

    def _render(self, text: str, active_view: str | None, bound: dict[str, Any]) -> str:
        if "{%" in text:
            raise PipelineError("template statements ({% ... %}) are not supported in SQL")
        text = _SCHEMA_PREFIX.sub(lambda m: self._known_view(m.group(1)), text)

        def identifier(expr: str) -> str | None:
            if expr == "active_table":
                if active_view is None:
                    raise PipelineError("this SQL has no active table")
                return active_view
            call = _TABLE_CALL.fullmatch(expr)
            return self._known_view(call.group(1)) if call else None

        def parameter(expr: str) -> str:
            value = self.value(expr)
            if value is None:
                raise PipelineError(f"no value for '{expr}'")
            if isinstance(value, (list, dict)):
                raise PipelineError(f"'{expr}' is not a scalar; read it with tables('...')")
            name = "v_" + re.sub(r"\W", "_", expr)
            bound[name] = value
            return f":{name}"

        def in_code(part: str) -> str:
            return _PLACEHOLDER.sub(lambda m: identifier(m.group(1)) or parameter(m.group(1)), part)

        def in_literal(part: str) -> str:
            quote = part[0]
            if not _PLACEHOLDER.search(part) or quote in "-/":
                return part
            if quote == "`":
                raise PipelineError(f"a value cannot be a name: {part}")
            pieces, last = [], 0
            body = part[1:-1]
            for match in _PLACEHOLDER.finditer(body):
                if match.start() > last:
                    pieces.append(quote + body[last : match.start()] + quote)
                pieces.append(f"CAST({parameter(match.group(1))} AS STRING)")
                last = match.end()
            if last < len(body):
                pieces.append(quote + body[last:] + quote)
            return pieces[0] if len(pieces) == 1 else "concat(" + ", ".join(pieces) + ")"

        # A placeholder such as {{ tables('x') }} holds quotes of its own, so identifiers
        # are replaced before the text is cut at quoted literals.
        text = _PLACEHOLDER.sub(lambda m: identifier(m.group(1)) or m.group(0), text)
        parts = _SQL_QUOTED.split(text)
        return "".join(in_literal(p) if i % 2 else in_code(p) for i, p in enumerate(parts))

    def _known_view(self, name: str) -> str:
        self.table(name)
        return self.view_name(name)
