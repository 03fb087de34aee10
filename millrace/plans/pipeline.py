"""Pipelines: steps composed into lazy DataFrames, routed forward."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.context import RunContext
from millrace.errors import ConditionError, PipelineError, SpecError
from millrace.functions.paths import nested_column, output_alias, column_and_position
from millrace.plans.positions import value_at
from millrace.plans.spec import END, NEXT, Input, Rule, Spec, Step, check_spec, parse_spec
from millrace.registry import OPERATORS, SOURCES
from millrace.session import written_table

log = logging.getLogger(__name__)

_LONE_PLACEHOLDER = re.compile(r"^\s*\{\{\s*(.*?)\s*\}\}\s*$")
_VALUE_SCOPES = ("inputs", "global_input", "input_data", "session")

# Declared input types and their Spark types.
INPUT_TYPES = {"string": "string", "integer": "bigint", "boolean": "boolean", "json": "string"}


# -- building blocks ----------------------------------------------------------------


def transform_chain(df: DataFrame | None, rules: list[Rule], ctx: RunContext) -> DataFrame | None:
    """Fold operators over a table."""
    return reduce(lambda frame, rule: OPERATORS.get(rule.operator)(frame, rule.params, ctx), rules, df)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows of all tables; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def present(df: DataFrame, output_config: dict | None) -> DataFrame:
    """The visible columns in the configured order, under their titles."""
    columns = (output_config or {}).get("columns")
    if not columns:
        return df
    return df.select(
        *[F.col(f"`{c['field']}`").alias(c.get("title") or c["field"]) for c in columns if c.get("visible", True)]
    )


def input_table(spark: SparkSession, rows: list[dict], columns: list[dict] | None = None) -> DataFrame:
    """A table-typed input as a DataFrame; absent cells take the column's default.

    The rows come with the run, so they are as small as a form a person fills in.
    """
    if not columns:
        names = list(dict.fromkeys(name for row in rows for name in row))
        columns = [{"name": name} for name in names]
    schema = T.StructType(
        [
            T.StructField(c["name"], T.DataType.fromDDL(INPUT_TYPES.get(c.get("type", "string"), "string")))
            for c in columns
        ]
    )

    def cell(row: dict, c: dict) -> Any:
        value = row.get(c["name"])
        value = c.get("default") if value is None else value
        if value is None:
            return None
        kind = c.get("type", "string")
        return int(value) if kind == "integer" else truth(value) if kind == "boolean" else str(value)

    return spark.createDataFrame([tuple(cell(r, c) for c in columns) for r in rows], schema)


_TRUTH = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}


def truth(value: Any) -> bool:
    """A boolean from a boolean, a number or a word for one."""
    if isinstance(value, str):
        if value.strip().lower() not in _TRUTH:
            raise PipelineError(f"'{value}' is no boolean")
        return _TRUTH[value.strip().lower()]
    return bool(value)


def holds(ctx: RunContext, condition: str | None) -> bool:
    """Evaluate a routing condition. No condition holds; NULL and no row do not."""
    if not condition:
        return True
    try:
        row = ctx.sql(f"SELECT ({condition}) AS holds").first()
    except Exception as error:
        raise ConditionError(f"routing condition failed [{condition}]: {error}") from error
    return bool(row["holds"]) if row is not None else False


def resolve_scalar(ctx: RunContext, path: str, default: Any = None, order_by: list[str] | None = None) -> Column:
    """A single value as a column: an input or session value, or a cell of a step table.

    ``table.column`` and ``table.column[i]`` need ``order_by``, since a distributed table
    has no row order of its own.
    """
    scope = path.split(".", 1)[0]
    if scope in _VALUE_SCOPES:
        value = ctx.value(path)
        if isinstance(value, list) and value:
            value = value[0]
        return F.lit(default if value is None else value)
    table, _, rest = path.partition(".")
    if table not in ctx.tables:
        return F.lit(default)
    rest = rest.removeprefix("output.")
    column, index = column_and_position(rest)
    df = ctx.table(table)
    if column not in df.columns:
        return F.lit(default)
    if not order_by:
        raise PipelineError(f"'{path}' reads by position: give order_by")
    found = value_at(df, column, index or 0, order_by)
    return found if default is None else F.coalesce(found, F.lit(default))


# -- runs ---------------------------------------------------------------------------


@dataclass
class StepRecord:
    """What is known of a step of a run: ``status`` is success, paused or failed."""

    step_no: int
    step_id: str
    output_dataset: str
    status: str = "success"
    rows_processed: int | None = None
    started: datetime | None = None
    ended: datetime | None = None
    error: str | None = None

    def failed(self, error: Exception) -> None:
        lines = str(error).strip().splitlines()
        self.status, self.ended, self.rows_processed = "failed", _now(), None
        self.error = f"{type(error).__name__}: {lines[0] if lines else ''}"


_RECORD = (
    "step_no int, step_id string, output_dataset string, status string, rows_processed bigint, started timestamp, ended timestamp, error string"
)


def _now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass
class PipelineRun:
    """What a run composed: lazy tables by name, error rows by step, and the route taken."""

    context: RunContext
    status: str = "success"
    route: list[str] = field(default_factory=list)
    errors: dict[str, DataFrame] = field(default_factory=dict)
    output_configs: dict[str, dict | None] = field(default_factory=dict)
    paused_at: str | None = None
    last_output: str | None = None
    records: list[StepRecord] = field(default_factory=list)
    _observed: dict[str, Observation] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.context.table(name)

    def result(self) -> DataFrame:
        """The output of the last step on the route."""
        return self.table(self.last_output)

    def presented(self, name: str) -> DataFrame:
        return present(self.table(name), self.output_configs.get(name))

    def audit(self) -> DataFrame:
        """One row for each step on the route, a failed one included.

        With ``audit=True`` rows are counted while they pass: what has been computed since
        is not computed again, and a step that nobody asked for yet runs now, the last one
        first, which takes those before it along. Otherwise every output is counted by
        itself. A step starts when it is put together and ends when its rows have been
        counted; one whose rows cannot be computed counts as failed.
        """
        waiting = [r for r in self.records if r.status != "failed" and r.rows_processed is None]
        for record in reversed(waiting):
            watch = self._observed.get(record.step_id)
            try:
                if watch is None:
                    record.rows_processed = self.table(record.output_dataset).count()
                else:
                    if not watch._jo.future().isCompleted():
                        self.table(record.output_dataset).write.format("noop").mode("overwrite").save()
                    record.rows_processed = watch.get["rows"]
                record.ended = _now()
            except Exception as error:
                record.failed(error)
        rows = [tuple(getattr(r, f.name) for f in fields(StepRecord)) for r in self.records]
        return self.context.spark.createDataFrame(rows, _RECORD)

    def observed(self) -> dict[str, int]:
        """Rows that passed each step during the last action, when run with ``audit=True``."""
        return {step: watch.get["rows"] for step, watch in self._observed.items()}


def run_pipeline(
    spark: SparkSession,
    spec: dict | Spec,
    inputs: dict[str, Any] | None = None,
    session: dict[str, Any] | None = None,
    tables: dict[str, DataFrame] | None = None,
    responses: dict[str, DataFrame] | None = None,
    fetchers: dict[str, Callable] | None = None,
    functions: dict[str, Callable] | None = None,
    history_root: str | None = None,
    run_id: str | None = None,
    audit: bool = False,
) -> PipelineRun:
    """Compose the steps of ``spec`` into lazy DataFrames.

    Jobs run only for routing conditions, error checks, history writes and steps marked
    ``materialize``. When a step fails, the exception's ``run`` holds what came before it
    and the step's record.

    ``tables`` are given step tables, ``responses`` captured responses by endpoint,
    ``fetchers`` functions that fetch responses by endpoint (``sources.fetching``),
    ``functions`` Python functions for ``python_script``. With ``audit`` each step's rows
    are counted as they pass, at the price of filters no longer moving between steps.
    """
    spec = parse_spec(spec)
    problems = check_spec(spec, tables or ())
    if problems:
        raise SpecError(problems)

    ctx = RunContext(
        spark,
        run_id=run_id,
        inputs=_with_defaults(spec.inputs, inputs or {}),
        session=session,
        responses=responses,
        fetchers=fetchers,
        functions=functions,
        history_root=history_root,
    )
    for item in spec.inputs:
        if item.type == "table":
            ctx.register(item.name, input_table(spark, ctx.inputs.get(item.name) or [], item.columns))
    for name, df in (tables or {}).items():
        ctx.register(name, df)

    run = PipelineRun(ctx)
    by_id = {step.step_id: i for i, step in enumerate(spec.steps)}
    index = 0
    while index < len(spec.steps):
        step = spec.steps[index]
        run.route.append(step.step_id)
        record = StepRecord(len(run.records), step.step_id, step.output_dataset, started=_now())
        run.records.append(record)
        try:
            paused = _run_step(step, run, audit)
        except Exception as error:
            record.failed(error)
            run.status = "failed"
            error.run = run
            raise
        if paused:
            run.status, run.paused_at, record.status = "paused", step.step_id, "paused"
            break
        target = NEXT
        if step.routing and step.routing.next_step and holds(ctx, step.routing.condition):
            target = step.routing.next_step
        if target == END:
            break
        index = index + 1 if target == NEXT else by_id[target]
    return run


def _with_defaults(declared: list[Input], given: dict[str, Any]) -> dict[str, Any]:
    values = dict(given)
    missing = []
    for item in declared:
        if values.get(item.name) is None:
            if item.default is not None:
                values[item.name] = item.default
            elif item.required:
                missing.append(item.name)
        if values.get(item.name) is not None:
            values[item.name] = _typed(item, values[item.name])
    if missing:
        raise SpecError([f"input '{name}' is required" for name in missing])
    return values


def _typed(item: Input, value: Any) -> Any:
    """An input in its declared type; a list is typed item by item."""
    if isinstance(value, list) and item.type in ("integer", "boolean"):
        return [_typed(item, v) for v in value]
    try:
        if item.type == "integer":
            return int(value)
        if item.type == "boolean":
            return truth(value)
        if item.type == "json" and isinstance(value, str):
            return json.loads(value)
    except ValueError as error:
        raise SpecError([f"input '{item.name}' is no {item.type}: {value!r}"]) from error
    return value


def _run_step(step: Step, run: PipelineRun, audit: bool) -> bool:
    ctx = run.context
    paused = False
    if step.fetches:
        fetched = SOURCES.get(step.driver)(step, _request(step, ctx), ctx)
        rows, paused = fetched.rows, fetched.paused
        if fetched.errors is not None:
            run.errors[step.step_id] = fetched.errors
        ctx.register(f"{step.step_id}_raw", rows)
    else:
        rows = ctx.table(step.inputs[0]) if step.inputs and step.inputs[0] else None
    rows = transform_chain(rows, step.transformations, ctx)
    if rows is None:
        raise PipelineError(f"step {step.step_id} has neither a source, an input nor SQL")
    if audit:
        watch = Observation(f"{ctx.namespace}_{step.step_id}")
        rows = rows.observe(watch, F.count(F.lit(1)).alias("rows"))
        run._observed[step.step_id] = watch
    ctx.register(step.output_dataset, written_table(rows) if step.materialize else rows)
    run.output_configs[step.output_dataset] = step.output_config
    run.last_output = step.output_dataset
    return paused


def _whole_column(ctx: RunContext, path: str) -> tuple[str, str] | None:
    """(table, column) when the path names a whole column of a step table."""
    table, _, rest = path.partition(".")
    column, index = column_and_position(rest.removeprefix("output."))
    known = table in ctx.tables and column in ctx.tables[table].columns
    return (table, column) if known and index is None else None


def _request(step: Step, ctx: RunContext):
    """Request values from the step's variables.

    Scalars: ``{"source": path, "default": v}`` or ``{"jsonpath": path}``. Datasets:
    ``{"type": "dataset", "columns": [{"field": path, "alias": name}]}``, or rows written
    out with lone ``{{ path }}`` cells.
    """
    from millrace.sources.steps import Request, Sent

    request = Request(driving=ctx.table(step.inputs[0]) if step.mode == "chained_loop" else None)

    def add(dataset: str | None, name: str, path: str, default: Any = None, order_by: list[str] | None = None) -> None:
        if path.startswith("loop_row") and request.driving is not None:
            value = nested_column(request.driving, path.removeprefix("loop_row").lstrip("."))
            value = value if default is None else F.coalesce(value, F.lit(default))
            request.row_columns[name] = value
        elif path.split(".", 1)[0] not in _VALUE_SCOPES and not order_by and _whole_column(ctx, path):
            # A column of a table, of any size, picks responses by a join; no body carries it.
            table, column = _whole_column(ctx, path)
            request.lists[name] = ctx.table(table).select(F.col(f"`{column}`").alias(name))
            return
        elif path.split(".", 1)[0] in _VALUE_SCOPES:
            value = ctx.value(path)
            value = default if value is None else value
            request.constants[name] = value
        else:
            value = resolve_scalar(ctx, path, default, order_by)
            request.constants[name] = value
        request.sent.append(Sent(dataset, name, value))

    def add_cell(dataset: str | None, name: str, cell: Any) -> None:
        lone = _LONE_PLACEHOLDER.match(cell) if isinstance(cell, str) else None
        if lone:
            add(dataset, name, lone[1])
        else:
            request.constants[name] = cell
            request.sent.append(Sent(dataset, name, cell))

    def listed(cells: list) -> list | Column:
        """Cells of a column written out row by row, their placeholders filled in."""
        values = []
        for cell in cells:
            lone = _LONE_PLACEHOLDER.match(cell) if isinstance(cell, str) else None
            if lone and lone[1].startswith("loop_row") and request.driving is not None:
                cell = nested_column(request.driving, lone[1].removeprefix("loop_row").lstrip("."))
            elif lone:
                cell = ctx.value(lone[1])
            values.append(cell)
        if not any(isinstance(v, Column) for v in values):
            return values
        columns = [v if isinstance(v, Column) else F.lit(v) for v in values]
        # One column has one type: beside text everything is text.
        as_text = any(isinstance(v, str) for v in values)
        return F.array(*[c.cast("string") if as_text else c for c in columns])

    for name, config in step.variables.items():
        if name == "headers":
            continue
        written_out = isinstance(config, dict) and "type" not in config
        if name == "datasets" and written_out:
            for dataset, rows in config.items():
                if not isinstance(rows, list):
                    add_cell(dataset, dataset, rows)
                elif len(rows) == 1:
                    for column, cell in rows[0].items():
                        add_cell(dataset, column, cell)
                else:
                    for column in rows[0] if rows else ():
                        add_cell(dataset, column, listed([row.get(column) for row in rows]))
        elif name == "parameters" and written_out:
            for parameter, cell in config.items():
                add_cell(None, parameter, cell)
        elif not isinstance(config, dict):
            add_cell(None, name, config)
        elif config.get("type") == "dataset":
            for column in config.get("columns") or []:
                path = column.get("field") or column.get("name", "")
                alias = column.get("alias") or output_alias(path)
                add(name, alias, path, order_by=column.get("order_by"))
        elif config.get("source") or config.get("jsonpath"):
            add(None, name, config.get("source") or config["jsonpath"], config.get("default"), config.get("order_by"))
        else:
            add_cell(None, name, config.get("default"))
    return request


def loop_requests(
    spark: SparkSession,
    spec: dict | Spec,
    step_id: str,
    inputs: dict[str, Any] | None = None,
    session: dict[str, Any] | None = None,
    tables: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """The request bodies a step sends: one per driving row, or one for a batch step.

    The driving row's columns come first, then ``body``, in XML or JSON as the step's
    source has it. ``tables`` holds the step's inputs.
    """
    from millrace.sources.requests import request_bodies

    spec = parse_spec(spec)
    step = next((s for s in spec.steps if s.step_id == step_id), None)
    if step is None:
        raise SpecError([f"no step '{step_id}'"])
    ctx = RunContext(spark, inputs=_with_defaults(spec.inputs, inputs or {}), session=session)
    for name, df in (tables or {}).items():
        ctx.register(name, df)
    return request_bodies(spark, step, _request(step, ctx))
