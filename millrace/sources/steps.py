"""Registered sources: what a fetching step reads.

Responses captured elsewhere are tables, one per endpoint, with ``status_code``, ``body``
and a column for each request value that tells responses apart. A batch step reads the
responses that match its request values. A loop step joins its input rows to the responses
on those values: one distributed join in place of one call per row. Where the caller gives
a function for an endpoint instead, it is called once for every different request.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.context import RunContext
from millrace.errors import MissingTable, PipelineError
from millrace.operators.filters import optional_search
from millrace.plans.spec import Step
from millrace.registry import SOURCES
from millrace.session import written_table
from millrace.sources import json_records, outcomes, spreadsheet, xml_envelope
from millrace.sources.fetching import PROBLEM, fetched_responses

_ROW = "__row_key_"
_ANSWERED = "__answered"


class Sent(NamedTuple):
    """One value of a request: a parameter, or a column of the named dataset.

    ``value`` is a constant, a list, a column of the driving row or a scalar subquery.
    """

    dataset: str | None
    name: str
    value: Any


@dataclass
class Request:
    """What a step sends, and by which values its responses are found."""

    driving: DataFrame | None = None
    sent: list[Sent] = field(default_factory=list)
    constants: dict[str, Any] = field(default_factory=dict)
    row_columns: dict[str, Column] = field(default_factory=dict)
    lists: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Fetched:
    rows: DataFrame
    errors: DataFrame | None = None
    paused: bool = False


class Answers(NamedTuple):
    """Responses to what was asked, the columns that tell them apart, and what a batch request asked in vain.

    A driving row without a response has a row without a body among the responses.
    """

    table: DataFrame
    keys: list[str]
    unanswered: DataFrame | None = None
    ids: list[DataFrame] = []


def _responses(step: Step, request: Request, ctx: RunContext) -> Answers:
    """The responses of the step's endpoint to what it asks, and the columns that tell them apart.

    Responses nobody asked for leave before they are parsed.
    """
    if step.endpoint in ctx.fetchers:
        table = _fetch(step, request, ctx)
    elif step.endpoint in ctx.responses:
        table = ctx.responses[step.endpoint]
    else:
        raise MissingTable(f"no captured responses for '{step.endpoint}'")
    keys = [c for c in table.columns if c not in ("status_code", "body", PROBLEM)]
    if request.driving is not None:
        return Answers(_asked_for(step, request, table, keys), keys)
    scalars, lists = {}, {}
    for name, value in [*request.constants.items(), *request.lists.items()]:
        if name not in table.columns or value is None or isinstance(value, dict):
            continue
        if isinstance(value, (list, DataFrame)):
            narrowed = optional_search(table, ids=(name, value))
            if narrowed is not table:  # else no id is set
                table, lists[name] = narrowed, value
        else:
            table = table.filter(F.col(f"`{name}`") == F.lit(value))
            scalars[name] = value
    if lists:
        return Answers(table, keys, ids=_unknown_ids(ctx.spark, table, lists))
    one = ctx.spark.range(1).select(*[_literal(v).cast(table.schema[n].dataType).alias(n) for n, v in scalars.items()])
    return Answers(table, keys, one.join(table.select(F.lit(1).alias(_ROW)).limit(1), F.lit(True), "left_anti"))


def _unknown_ids(spark: SparkSession, table: DataFrame, lists: dict[str, Any]) -> list[DataFrame]:
    """The ids of a batch request's lists that no response is for."""
    found = []
    for name, ids in lists.items():
        ids = ids if isinstance(ids, DataFrame) else spark.createDataFrame([(str(v),) for v in ids if v is not None], "id string")
        # A request carries text, so values of unlike types meet as text.
        wanted = ids.select(F.col(f"`{ids.columns[0]}`").cast("string").alias(_ROW)).filter(F.col(_ROW) != "").distinct()
        there = table.select(F.col(f"`{name}`").cast("string").alias(_ROW))
        found.append(wanted.join(there, _ROW, "left_anti").select(F.col(_ROW).try_cast(table.schema[name].dataType).alias(name)))
    return found


def _literal(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _fetch(step: Step, request: Request, ctx: RunContext) -> DataFrame:
    """Replies of the caller's function to every different request."""
    from millrace.sources.requests import request_bodies

    if request.driving is None:
        known = {n: v for n, v in request.constants.items() if v is not None and not isinstance(v, (list, dict))}
        body = request_bodies(ctx.spark, step, request)
        return fetched_responses(body.select(*[_literal(v).alias(n) for n, v in known.items()], "body"), ctx.fetchers[step.endpoint])
    names = {n: _ROW + n for n in request.row_columns}
    if not names:
        raise PipelineError(f"step {step.step_id}: its requests do not depend on the driving rows")
    rows = request.driving.select("*", *[c.alias(names[n]) for n, c in request.row_columns.items()])
    rows = rows.dropna(subset=list(names.values())).dropDuplicates(list(names.values()))
    bodies = request_bodies(ctx.spark, step, replace(request, driving=rows))
    asked = bodies.select(*[F.col(v).alias(n) for n, v in names.items()], "body")
    return fetched_responses(asked, ctx.fetchers[step.endpoint])


def _asked_for(step: Step, request: Request, table: DataFrame, keys: list[str]) -> DataFrame:
    """Every different request value with its responses, or one row without a body.

    One join both drops the responses nobody asked for and finds the values nobody
    answered. A NULL value has no response.
    """
    shared = _shared(step, request, keys)
    asked = request.driving.select(*[request.row_columns[n].alias(_ROW + n) for n in shared]).distinct()
    # A request carries text, so values of unlike types meet as text.
    for n in shared:
        if asked.schema[_ROW + n].dataType != table.schema[n].dataType:
            asked = asked.withColumn(_ROW + n, F.col(_ROW + n).cast("string"))
            table = table.withColumn(n, F.col(n).cast("string"))
    match = reduce(lambda a, b: a & b, [F.col(_ROW + n) == F.col(n) for n in shared])
    # Bodies are of any length, which Spark's estimate does not see: a broadcast would hold them all.
    joined = asked.join(table.withColumn(_ANSWERED, F.lit(True)).hint("merge"), match, "left")
    named = [F.coalesce(F.col(n), F.col(_ROW + n)).alias(n) if n in shared else F.col(f"`{n}`") for n in table.columns]
    return joined.select(*named, F.coalesce(_ANSWERED, F.lit(False)).alias(_ANSWERED))


def _shared(step: Step, request: Request, keys: list[str]) -> list[str]:
    shared = [name for name in request.row_columns if name in keys]
    if not shared:
        raise PipelineError(
            f"step {step.step_id}: the responses have no column among {sorted(request.row_columns)}"
        )
    return shared


def _enrich(step: Step, request: Request, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Repeat each response's rows for every driving row that asks for it."""
    shared = _shared(step, request, keys)
    asked = request.driving.select(*[request.row_columns[n].alias(_ROW + n) for n in shared])
    # A request carries text, so values of unlike types meet as text.
    for n in shared:
        if asked.schema[_ROW + n].dataType != rows.schema[f"__key_{n}"].dataType:
            asked = asked.withColumn(_ROW + n, F.col(_ROW + n).cast("string"))
            rows = rows.withColumn(f"__key_{n}", F.col(f"__key_{n}").cast("string"))
    match = reduce(lambda a, b: a & b, [F.col(_ROW + n) == F.col(f"__key_{n}") for n in shared])
    # Spark's estimate sees neither how many rows a body has nor how far files are compressed: no side is broadcast by it.
    return asked.join(rows.hint("merge"), match).drop(*[_ROW + n for n in shared])


def _split(step: Step, tagged: DataFrame, answers: Answers, strategy: str) -> outcomes.Split:
    """Errors are looked for before rows are read, and responses are parsed once.

    A request without a response counts as not delivered. Ids of a list that nobody
    answered are errors as well, but no reason to stop: a list only narrows a search.
    """
    if PROBLEM in tagged.columns:
        tagged = tagged.withColumn("err_msg", F.coalesce("err_msg", PROBLEM)).drop(PROBLEM)
    if _ANSWERED in tagged.columns:
        tagged = tagged.withColumn("err_msg", F.when(F.col(_ANSWERED), F.col("err_msg")).otherwise(outcomes.NO_RESPONSE)).drop(_ANSWERED)
    tags = {"outcome": F.lit("transport"), "err_code": F.lit(None).cast("string"), "err_msg": F.lit(outcomes.NO_RESPONSE)}
    if answers.unanswered is not None:
        tagged = tagged.unionByName(answers.unanswered.withColumns(tags), allowMissingColumns=True)
    # Looking for errors reads the rows once, going on reads them again.
    twice = step.materialize or strategy in outcomes.LOOKS_FIRST
    split = outcomes.split_errors(written_table(tagged) if twice else tagged, strategy)
    errors = reduce(lambda e, ids: e.unionByName(ids.withColumns(tags), allowMissingColumns=True), answers.ids, split.errors)
    return split._replace(errors=errors)


def _finish(step: Step, request: Request, split: outcomes.Split, rows_of, keys: list[str]) -> Fetched:
    renamed = {k: f"__key_{k}" for k in keys}
    if request.driving is not None:
        rows = _enrich(step, request, rows_of(split.ok.withColumnsRenamed(renamed), list(renamed.values())), keys)
    else:
        rows = rows_of(split.ok.withColumnsRenamed(renamed), list(renamed.values()))
    rows = rows.drop(*renamed.values(), "row_no")
    return Fetched(rows, split.errors, split.paused)


@SOURCES.register("xml")
def xml_source(step: Step, request: Request, ctx: RunContext) -> Fetched:
    answers = _responses(step, request, ctx)
    parsed = xml_envelope.parse_xml_envelope(answers.table, wrapper=step.response.wrapper)
    handling, strategy = _handling(step)
    split = _split(step, outcomes.tag_xml(parsed, **handling), answers, strategy)

    def rows_of(ok: DataFrame, keep: list[str]) -> DataFrame:
        if step.response.join:
            join = step.response.join
            return xml_envelope.datasets_join(ok, join["datasets"], join["on"], keep)
        columns = step.response.columns
        if columns is None:
            columns = xml_envelope.discover_columns(ok, step.response.dataset)
        return xml_envelope.envelope_rows(ok, step.response.dataset, columns, keep)

    return _finish(step, request, split, rows_of, answers.keys)


@SOURCES.register("json", "rest")
def json_source(step: Step, request: Request, ctx: RunContext) -> Fetched:
    answers = _responses(step, request, ctx)
    parsed = json_records.parse_json(answers.table)
    handling, strategy = _handling(step)
    tagged = outcomes.tag_json(parsed, check=step.error_handling is not None, **handling)
    split = _split(step, tagged, answers, strategy)

    def rows_of(ok: DataFrame, keep: list[str]) -> DataFrame:
        columns = step.response.columns
        if columns is None:
            columns = json_records.discover_fields(ok)
        elif isinstance(columns, (list, tuple)):
            columns = {name: "string" for name in columns}
        return json_records.json_records(ok, columns, keep)

    return _finish(step, request, split, rows_of, answers.keys)


def _handling(step: Step) -> tuple[dict[str, Any], str]:
    given = step.error_handling
    if given is None:
        return {}, "pause_for_manual"
    values = {"code_field": given.code_field, "msg_field": given.msg_field}
    if given.success_value is not None:
        values["success_value"] = given.success_value
    return values, given.on_error


@SOURCES.register("spreadsheet", "excel_ingest")
def spreadsheet_source(step: Step, request: Request, ctx: RunContext) -> Fetched:
    path = step.endpoint or request.constants.get("file_path")
    books = spreadsheet.read_workbooks(ctx.spark, path)
    columns = step.response.columns
    if columns is None:
        names = spreadsheet.scan_spreadsheets(books).select(F.explode(F.map_keys("cells")).alias("name")).distinct()
        columns = sorted(r["name"] for r in names.collect())
    return Fetched(spreadsheet.scan_spreadsheets(books, columns).drop("path", "row_no"))


@SOURCES.register("parquet")
def parquet_source(step: Step, request: Request, ctx: RunContext) -> Fetched:
    return Fetched(ctx.spark.read.parquet(step.endpoint))


@SOURCES.register("table")
def table_source(step: Step, request: Request, ctx: RunContext) -> Fetched:
    return Fetched(ctx.spark.table(step.endpoint))
