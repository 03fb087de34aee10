"""``accumulate_data``: append to a history table, keep the latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.context import RunContext
from millrace.errors import PipelineError
from millrace.plans.history import History
from millrace.registry import OPERATORS


@OPERATORS.register("accumulate_data")
def accumulate_data(df: DataFrame, params: dict, ctx: RunContext) -> DataFrame:
    """Merge ``df`` into the named history and return the whole history.

    The history outlives the run, so this operator writes; all others stay lazy. The run
    must name a lasting ``history_root``.
    """
    root = ctx.history_root
    if not root:
        raise PipelineError("accumulate_data needs a history_root")
    keys = params.get("dedup_keys", ["product_id"])
    history = History(
        ctx.spark,
        f"{root}/{params.get('target_history_table', 'ds_history')}",
        keys=[keys] if isinstance(keys, str) else list(keys),
        order_by=params.get("order_by", "created_date DESC"),
        buckets=int(params["buckets"]) if params.get("buckets") else None,
    )
    history.merge(df, batch_id=params.get("batch_id"))
    return history.read()
