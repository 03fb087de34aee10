"""User Python: over the DataFrame, over Arrow batches, or per key in two phases."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.context import RunContext
from millrace.errors import PipelineError
from millrace.registry import OPERATORS

PandasFn = Callable[[pd.DataFrame], pd.DataFrame]


def map_batches(df: DataFrame, fn: PandasFn, schema: str) -> DataFrame:
    """Row-wise user code: ``fn`` sees one Arrow batch at a time, in every partition."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(batches, schema)


def reduce_groups(
    df: DataFrame,
    keys: Sequence[str],
    partial: PandasFn,
    merge: PandasFn,
    schema: str,
    salts: int = 64,
) -> DataFrame:
    """Per-key user code that never holds a whole group.

    ``partial`` turns a batch into partial rows of ``schema``, the keys among them.
    ``merge`` takes partial rows of many keys and returns one row per key, in the same
    shape; merging merged rows must give the same answer. Rows are merged per batch,
    then per key and salt, then per key, so a hot key is spread over ``salts`` tasks and
    the last one sees at most one row from each.
    """
    keys = list(keys)

    def first_pass(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield merge(partial(frame))

    def merge_sorted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows arrive sorted by key, so only the last key of a batch can still grow.
        carry: pd.DataFrame | None = None
        for frame in frames:
            if frame.empty:
                continue
            merged = merge(frame if carry is None else pd.concat([carry, frame], ignore_index=True))
            last = frame.iloc[-1]
            open_key = pd.Series(True, index=merged.index)
            for key in keys:
                value = last[key]
                open_key &= merged[key].isna() if pd.isna(value) else merged[key] == value
            carry = merged[open_key]
            if not open_key.all():
                yield merged[~open_key]
        if carry is not None:
            yield carry

    partials = df.mapInPandas(first_pass, schema)
    salted = partials.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    shares = salted.repartition(*keys, "__salt").drop("__salt").sortWithinPartitions(*keys)
    shares = shares.mapInPandas(merge_sorted, schema)
    return shares.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(merge_sorted, schema)


@OPERATORS.register("python_script")
def python_script(df: DataFrame, params: dict, ctx: RunContext) -> DataFrame:
    """Call a Python function given to the run, by name or directly.

    Without ``schema`` the function is ``f(DataFrame, ctx) -> DataFrame``. With ``schema``
    it maps pandas batches; with ``keys`` and ``merge`` as well it reduces groups. Code
    held as text in a spec is never executed.
    """
    if "script" in params:
        raise PipelineError("script text is not executed; pass the function to the run instead")

    def lookup(ref) -> Callable:
        if callable(ref):
            return ref
        if ref not in ctx.functions:
            raise PipelineError(f"no Python function '{ref}' was given to this run")
        return ctx.functions[ref]

    fn = lookup(params.get("function", "transform_data"))
    if params.get("keys"):
        return reduce_groups(df, params["keys"], fn, lookup(params["merge"]), params["schema"])
    if params.get("schema"):
        return map_batches(df, fn, params["schema"])
    result = fn(df, ctx)
    if not isinstance(result, DataFrame):
        raise PipelineError("a Python step must return a DataFrame")
    return result
