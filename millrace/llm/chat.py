"""Tool-call linking in conversations (operator 8, native).

Calls and results are hash-joined by identifier. A call may depend on another; its level is
the number of calls before it in its chain, found by doubling the stretch of the chain that
each call knows, so order (level, turn, call_id) puts every call after what it needs.
Arguments are parsed and held against the schema of the call's name. Records come out as
canonical JSON: names sorted, no white space.

The given conversations hold no tool calls, so ``turns_as_calls`` reads each user turn as a
call of ``reply``, answered by the assistant's next turn and dependent on the user turn
before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import cut, table

#: Arguments by name of the call: type as the variant's schema gives it, and whether it must be there.
SCHEMAS = {"reply": {"text": ("STRING", True), "turn": ("BIGINT", True), "tone": ("STRING", False)}}


def _valid(name: Column, arguments: Column, schemas: dict) -> Column:
    """Whether the arguments are an object that has what its schema asks for, and nothing else."""
    out = F.lit(False)
    names = F.json_object_keys(F.to_json(arguments))
    for call, fields in schemas.items():
        fits = names.isNotNull() & (F.size(F.array_except(names, F.array(*map(F.lit, fields)))) == 0)
        for field, (kind, required) in fields.items():
            found = F.schema_of_variant(F.variant_get(arguments, F.lit(f"$.{field}"), "variant"))
            fits = fits & F.coalesce(found == kind, F.lit(not required))
        out = F.when(name == call, F.coalesce(fits, F.lit(False))).otherwise(out)
    return out


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of ``calls`` (call_id, parent); NULL where the chain is a circle.

    A parent that is no call counts as none.
    """
    ids = calls.select(F.col("call_id").alias("parent"))
    roots = calls.join(ids, "parent", "left_semi").select("call_id", "parent")
    known = cut(calls.select("call_id").join(roots, "call_id", "left").select("call_id", F.col("parent").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("level")))
    open_before = None
    while True:
        left = known.where("to IS NOT NULL").count()
        if left == 0:
            return known.select("call_id", "level")
        if open_before is not None and left == open_before:  # what is left are circles and what hangs on them
            return known.select("call_id", F.when(F.col("to").isNull(), F.col("level")).alias("level"))
        open_before = left
        far = known.select(F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("level").alias("more"))
        known = cut(known.join(far, "to", "left").select("call_id", F.col("next").alias("to"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """A row for each identifier of a call or result, its JSON record, and what is wrong with it.

    ``calls`` has call_id, conv_id, turn, name, arguments (JSON text), parent; ``results``
    has call_id, turn, content. Of several calls or results with one identifier the first
    by turn, then by content, counts; ``n_calls`` and ``n_results`` tell how many there
    were. Rows without an identifier are left out. Arguments that are no JSON are invalid
    and null in the record.
    """
    first_call = (
        calls.where("call_id IS NOT NULL")
        .groupBy("call_id")
        .agg(F.min(F.struct("turn", "name", "arguments", "parent", "conv_id")).alias("c"), F.count("*").alias("n_calls"))
    )
    first_call = cut(first_call.select("call_id", "c.*", "n_calls"))
    first_result = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    first_result = first_result.select("call_id", F.col("r.content").alias("content"), "n_results")
    joined = first_call.join(first_result.hint("shuffle_hash"), "call_id", "full").join(levels(first_call.select("call_id", "parent")), "call_id", "left")
    arguments = F.try_parse_json("arguments")
    record = F.struct(arguments.alias("arguments"), "call_id", F.col("parent").alias("depends_on"), "level", "name", F.col("content").alias("result"))
    return joined.select(
        "conv_id",
        "turn",
        "call_id",
        "level",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.coalesce(_valid(F.col("name"), arguments, schemas), F.lit(False)).alias("valid"),
        F.to_json(record, {"ignoreNullFields": "false"}).alias("record"),
    )


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from conversations (conv_id, turn, role, text)."""
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn = F.col("turn").cast("long")
    asked = turns.where("role = 'user'").select(
        name(turn).alias("call_id"),
        "conv_id",
        turn.alias("turn"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct(turn.alias("turn"), "text")).alias("arguments"),
        F.when(turn >= 2, name(turn - 2)).alias("parent"),
    )
    answered = turns.where("role = 'assistant'").select(name(turn - 1).alias("call_id"), turn.alias("turn"), F.col("text").alias("content"))
    return asked, answered


def op8(spark, sf_dir) -> DataFrame:
    return link(*turns_as_calls(table(spark, sf_dir, "conversations")))
