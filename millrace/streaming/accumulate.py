"""Accumulate arriving rows into a history table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.plans.history import History


def accumulate_stream(
    stream: DataFrame,
    history: History,
    name: str,
    checkpoint: str,
    event_time: str | None = None,
    delay: str | None = None,
    distinct_on: Sequence[str] | None = None,
) -> StreamingQuery:
    """Merge each micro-batch into ``history`` until the available input is used up.

    The history keeps the latest row per key, so rows may arrive late, twice or in any
    order. ``name`` and the batch number identify a merge: a batch replayed after a failure
    finds itself committed and is not applied again.

    ``distinct_on`` drops repeats of an event before they reach the history, within
    ``delay`` of ``event_time``. That bounds the state kept, but Spark then also drops rows
    later than ``delay``; leave it out where every late row matters.
    """
    if distinct_on:
        if event_time is None or delay is None:
            raise ValueError("distinct_on needs event_time and delay")
        # A watermark takes an instant, not a wall-clock time.
        stream = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
        stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(distinct_on))

    def merge(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                history.merge(batch, batch_id=f"{name}-{number}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(merge)
        .start()
    )
