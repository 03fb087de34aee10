"""Sorting captured responses into usable ones and errors.

A response row has ``status_code`` and a body. Tagging adds ``outcome`` (``ok``,
``transport`` or ``business``), ``err_code`` and ``err_msg``; nothing is dropped.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import BusinessFailure, PipelineError, TransportFailure
from millrace.sources.json_records import PAYLOAD, member
from millrace.sources.xml_envelope import ENVELOPE, parameter

# Status codes that count as delivered, and the default fields and texts.
XML_DELIVERED = (200,)
JSON_DELIVERED = (200, 201)
XML_CODE_FIELD, XML_MESSAGE_FIELD, XML_SUCCESS = "ErrorCode", "ErrorMsg", 0
JSON_CODE_FIELD, JSON_MESSAGE_FIELD, JSON_SUCCESS = "code", "message", 200
NO_MESSAGE = "Unknown error"
NO_RESPONSE = "no response"
UNREADABLE_CODE = -1
STRATEGIES = ("pause_for_manual", "skip_row", "continue", "fail")
#: Strategies that look for an error before going on.
LOOKS_FIRST = ("fail", "pause_for_manual")


def _tag(df: DataFrame, delivered: Column, readable: Column, failed: Column, code: Column, message: Column) -> DataFrame:
    usable = F.coalesce(delivered & readable, F.lit(False))
    business = usable & F.coalesce(failed, F.lit(False))
    outcome = F.when(~usable, "transport").when(business, "business").otherwise("ok")
    return (
        df.withColumn("outcome", outcome)
        .withColumn("err_code", F.when(business, code).when(~usable, F.col("status_code").cast("string")))
        .withColumn("err_msg", F.when(business, message))
    )


def tag_xml(
    df: DataFrame,
    code_field: str = XML_CODE_FIELD,
    msg_field: str = XML_MESSAGE_FIELD,
    success_value: int = XML_SUCCESS,
) -> DataFrame:
    """Tag rows parsed by ``parse_xml_envelope``. An absent code is 0, an unreadable one -1."""
    code = F.coalesce(F.coalesce(parameter(code_field), F.lit("0")).try_cast("bigint"), F.lit(UNREADABLE_CODE))
    return _tag(
        df,
        F.col("status_code").isin(*XML_DELIVERED),
        F.col(ENVELOPE).readable,
        code != F.lit(success_value),
        code.cast("string"),
        F.coalesce(parameter(msg_field), F.lit(NO_MESSAGE)),
    )


def tag_json(
    df: DataFrame,
    check: bool = True,
    code_field: str = JSON_CODE_FIELD,
    msg_field: str = JSON_MESSAGE_FIELD,
    success_value=JSON_SUCCESS,
) -> DataFrame:
    """Tag rows parsed by ``parse_json``.

    A code counts only if the body is an object that has the field, and compares by type:
    text ``"200"`` and JSON null differ from the number 200, while 200.0 equals it.
    """
    code = F.try_variant_get(PAYLOAD, member(code_field), "variant")
    kind = F.schema_of_variant(code)
    text = F.try_variant_get(PAYLOAD, member(code_field), "string")
    if isinstance(success_value, bool):
        equal = (kind == "BOOLEAN") & (text == str(success_value).lower())
    elif isinstance(success_value, (int, float)):
        number = F.try_variant_get(PAYLOAD, member(code_field), "double")
        equal = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number == F.lit(float(success_value)))
    else:
        equal = (kind == "STRING") & (text == F.lit(success_value))
    failed = kind.isNotNull() & ~F.coalesce(equal, F.lit(False)) if check else F.lit(False)
    message = F.try_variant_get(PAYLOAD, member(msg_field), "string")
    return _tag(
        df,
        F.col("status_code").isin(*JSON_DELIVERED),
        F.col(PAYLOAD).isNotNull(),
        F.schema_of_variant(PAYLOAD).startswith("OBJECT") & failed,
        text,
        F.coalesce(message, F.lit(NO_MESSAGE)),
    )


class Split(NamedTuple):
    ok: DataFrame
    errors: DataFrame
    paused: bool


def split_errors(tagged: DataFrame, strategy: str = "pause_for_manual") -> Split:
    """Part the rows by outcome under a strategy.

    ``skip_row`` and ``continue`` go on with the usable rows and keep the rest aside.
    ``fail`` raises on the first error. ``pause_for_manual`` goes on like ``skip_row`` but
    reports whether a business error asks for attention; delivery failures always raise
    there, as they do under ``fail``.
    """
    if strategy not in STRATEGIES:
        raise PipelineError(f"unknown error strategy '{strategy}'")
    ok = tagged.filter(F.col("outcome") == "ok")
    errors = tagged.filter(F.col("outcome") != "ok")
    paused = False
    if strategy in LOOKS_FIRST:
        found = (
            errors.select("outcome", "err_code", "err_msg").orderBy(F.desc("outcome")).limit(1).collect()
        )  # a delivery failure sorts before a business error
        if found and found[0]["outcome"] == "transport":
            raise TransportFailure(f"a response was not delivered or not readable (status {found[0]['err_code']})")
        if found and strategy == "fail":
            raise BusinessFailure(found[0]["err_code"], found[0]["err_msg"])
        paused = bool(found)
    return Split(ok, errors, paused)
