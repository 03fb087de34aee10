"""Window functions, as-of and range joins that do not put one key into one task.

A plain window sorts all rows of a key in a single task. Here the rows are cut into
consecutive stretches along keys and order. What other stretches of a key contribute comes
from a table with one row per key and stretch, built by partial aggregation. Its rows are
put at the head of the stretch they belong to, so one sort per stretch gives the result.

Stretches come from a range partitioning over keys, order, a row hash and the input
partition, so they are of even size whatever the data looks like: one key, one day or one
value may hold most rows, and copies of one row are kept together only as far as one input
partition held them.
That partitioning is written to the shared folder, because it is read twice and a second
sampling could cut elsewhere. Where the caller knows that a coarser value of the order (a
day, a step) stays small for every key, a ``bucket`` expression saves that write.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.operators.latest import row_digest
from millrace.plans.merging import Merged
from millrace.session import written_table

_B = "__bucket"
_O = "__order"
_ROW = "__is_row"
_CARRY = "__carry"


class Frames(NamedTuple):
    """Windows over the per-stretch table: in order, earlier stretches, all stretches."""

    ordered: WindowSpec
    before: WindowSpec
    whole: WindowSpec


class Measure(NamedTuple):
    """How one output column is put together.

    ``report`` aggregates a stretch, ``carry`` turns reports into what a stretch receives,
    ``row`` computes the output over a stretch whose first row is the received one.
    """

    report: Column
    carry: Callable[[Column, Frames], Column]
    row: Callable[[Column, WindowSpec], Column]


def _so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier(report: Column, frames: Frames) -> Column:
    return F.coalesce(F.sum(report).over(frames.before), F.lit(0))


def row_number() -> Measure:
    return Measure(F.count(F.lit(1)), _earlier, lambda got, w: got + F.row_number().over(w) - 1)


def ntile(tiles: int) -> Measure:
    """Near-equal shares in order; when they do not divide, the first take one row more."""

    def carry(report: Column, frames: Frames) -> Column:
        return F.struct(_earlier(report, frames).alias("n"), F.sum(report).over(frames.whole).alias("total"))

    def row(got: Column, w: WindowSpec) -> Column:
        position = got["n"] + F.row_number().over(w) - 2
        share, spare = F.floor(got["total"] / tiles), got["total"] % tiles
        long_part = spare * (share + 1)
        in_long = F.floor(position / (share + 1))
        in_short = spare + F.floor((position - long_part) / F.greatest(share, F.lit(1)))
        return F.when(position < long_part, in_long).otherwise(in_short) + 1

    return Measure(F.count(F.lit(1)), carry, row)


def running_sum(column: str) -> Measure:
    """Sum of the rows so far; NULL until the first value, as in SQL."""

    def row(got: Column, w: WindowSpec) -> Column:
        here = F.sum(column).over(_so_far(w))
        return F.coalesce(got + here, got, here)

    return Measure(F.sum(column), lambda report, f: F.sum(report).over(f.before), row)


def running(column: str, merged: Merged) -> Measure:
    """What ``merged`` gave of parts, put together over the rows so far."""
    return Measure(
        merged.again(column),
        lambda report, f: merged.again(report).over(f.before),
        lambda got, w: merged.both(got, merged.again(column).over(_so_far(w))),
    )


def total(column: str) -> Measure:
    return Measure(F.sum(column), lambda report, f: F.sum(report).over(f.whole), lambda got, w: got)


def lag(column: str) -> Measure:
    return Measure(
        F.max_by(column, _O),
        lambda report, f: F.lag(report).over(f.ordered),
        lambda got, w: F.when(F.row_number().over(w) == 2, got).otherwise(F.lag(column).over(w)),
    )


def lead(column: str) -> Measure:
    return Measure(
        F.min_by(column, _O),
        lambda report, f: F.lead(report).over(f.ordered),
        lambda got, w: F.when(F.lead(_ROW).over(w), F.lead(column).over(w)).otherwise(got),
    )


def last_known(column: str) -> Measure:
    """The latest value so far that is not NULL."""
    return Measure(
        F.max_by(column, F.when(F.col(column).isNotNull(), F.col(_O))),
        lambda report, f: F.last(report, ignorenulls=True).over(f.before),
        lambda got, w: F.coalesce(F.last(column, ignorenulls=True).over(_so_far(w)), got),
    )


def _edge(report: Column, pick: Callable[[Column], Column], frames: Frames) -> Column:
    everything = frames.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return pick(report).over(everything)


def first_value(column: str) -> Measure:
    return Measure(F.min_by(column, _O), lambda report, f: _edge(report, F.first, f), lambda got, w: got)


def last_value(column: str) -> Measure:
    """Value of the key's last row, as with a frame that reaches the end."""
    return Measure(F.max_by(column, _O), lambda report, f: _edge(report, F.last, f), lambda got, w: got)


def _even_stretches(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Exact copies are told apart by the input partition they come from. Unlike a row id
    # that does not change when a lost task runs again and reads its rows in another order.
    origin = "__origin"
    ranged = df.withColumn(origin, F.spark_partition_id()).repartitionByRange(count, *keys, *order, row_digest(df), origin)
    return written_table(ranged.drop(origin).withColumn(_B, F.spark_partition_id()))


def with_measures(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, Measure],
    bucket: Column | None = None,
) -> DataFrame:
    """Add window columns over ``keys`` in ascending ``order`` (NULLs first).

    A given ``bucket`` must not decrease along the order. Rows with NULL keys form a group
    of their own. Positions among ties are arbitrary, as in any window: give an order
    without ties where that matters.
    """
    keys = list(keys)
    rows = _even_stretches(df, keys, order) if bucket is None else df.withColumn(_B, bucket)
    # A struct also for one column: rows without an order value count as the first.
    position = F.struct(*[F.col(o) for o in order])
    rows = rows.withColumn(_O, position)

    by_stretch = rows.groupBy(*keys, _B).agg(*[m.report.alias(f"__{out}") for out, m in measures.items()])
    ordered = Window.partitionBy(*keys).orderBy(F.col(_B).asc_nulls_first())
    frames = Frames(ordered, ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys))
    received = F.struct(*[m.carry(F.col(f"__{out}"), frames).alias(out) for out, m in measures.items()])
    heads = by_stretch.select(*keys, _B, F.lit(False).alias(_ROW), received.alias(_CARRY))

    stretch = Window.partitionBy(*keys, _B).orderBy(_ROW, _O)
    got = F.first(_CARRY).over(_so_far(stretch))
    together = rows.withColumn(_ROW, F.lit(True)).unionByName(heads, allowMissingColumns=True)
    outputs = [m.row(got[out], stretch).alias(out) for out, m in measures.items()]
    return together.select(*df.columns, _ROW, *outputs).filter(_ROW).drop(_ROW)


def _null_safe(columns: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in columns], F.lit(True))


def _join_back(df: DataFrame, per_value: DataFrame, columns: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """Give each row the outputs of its group; a crowded group is a skewed join, which AQE splits."""
    named = per_value.select(*[F.col(c).alias(f"__r_{c}") for c in columns], *outputs)
    return df.join(named, _null_safe(columns, "__r_")).select(*df.columns, *outputs)


def with_ranks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rank: str,
    dense_rank: str,
    bucket: Column | None = None,
) -> DataFrame:
    """Add ``rank`` and ``dense_rank`` over ``keys`` in ascending ``order``.

    Ties are counted before anything is sorted, so any number of rows may tie.
    """
    values = df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("__n"))
    placed = with_measures(
        values, keys, order, {dense_rank: row_number(), "__upto": running_sum("__n")}, bucket
    ).withColumn(rank, F.col("__upto") - F.col("__n") + 1)
    return _join_back(df, placed, [*keys, *order], [rank, dense_rank])


def trailing_sum(
    df: DataFrame, keys: Sequence[str], position: Column, width: int, sums: dict[str, str], bucket: bool = False
) -> DataFrame:
    """Sums over the rows of the key from ``position - width`` to ``position``, ends included.

    ``position`` is a whole number, such as microseconds, and ``sums`` maps outputs to
    columns of whole numbers or decimals. A sliding frame would add up its rows again for
    each row. Here every row also leaves: it counts against the sum past ``position +
    width``, so a running sum over arrivals and departures gives the answer. Both are
    summed per position first. ``bucket`` uses steps of ``width`` as stretches.
    """
    keys, columns = list(keys), sorted(set(sums.values()))
    at, kind, arrives = "__at", "__kind", 0
    placed = df.withColumn(at, position)
    amounts = [F.sum(c).alias(f"__d_{c}") for c in columns] + [F.count(c).alias(f"__n_{c}") for c in columns]
    arriving = placed.groupBy(*keys, at).agg(*amounts).withColumn(kind, F.lit(arrives))
    leaving = arriving.select(
        *keys,
        (F.col(at) + width).alias(at),
        *[(-F.col(f"__{part}_{c}")).alias(f"__{part}_{c}") for part in ("d", "n") for c in columns],
        F.lit(arrives + 1).alias(kind),
    )
    step = F.floor(F.col(at) / width) if bucket else None
    running = {f"__{part}_{c}_now": running_sum(f"__{part}_{c}") for part in ("d", "n") for c in columns}
    swept = with_measures(arriving.unionByName(leaving), keys, [at, kind], running, step).filter(
        F.col(kind) == arrives
    )
    results = [
        F.when(F.col(f"__n_{c}_now") > 0, F.col(f"__d_{c}_now")).alias(out) for out, c in sums.items()
    ]
    joined = _join_back(placed, swept.select(*keys, at, *results), [*keys, at], list(sums))
    return joined.select(*df.columns, *sums)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    bucket: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Each left row with the ``values`` of the last right row at or before its time.

    Both sides are put in one order of key and time, and each left row takes the last right
    row known by then. Left rows without a match keep NULLs. Right rows of one key should
    have distinct times; among equal times the greatest values win. ``bucket`` maps a time
    to a stretch known to be small.
    """
    on, values = list(on), list(values)
    t, side, pick = "__time", "__side", "__right"
    known = F.struct(*[F.col(v) for v in values])
    right_rows = right.filter(F.col(right_time).isNotNull()).select(
        *on, F.col(right_time).alias(t), F.lit(1).alias(side), known.alias(pick)
    )
    left_rows = left.withColumn(t, F.col(left_time)).withColumn(side, F.lit(2))
    found = with_measures(
        left_rows.unionByName(right_rows, allowMissingColumns=True),
        on,
        [t, side, pick],
        {"__found": last_known(pick)},
        bucket(F.col(t)) if bucket else None,
    )
    matches = F.col(left_time).isNotNull()
    for key in on:
        matches = matches & F.col(key).isNotNull()
    return found.filter(F.col(side) == 2).select(
        *left.columns, *[F.when(matches, F.col("__found").getField(v)).alias(v) for v in values]
    )


def range_join(
    points: DataFrame,
    ranges: DataFrame,
    point: str,
    low: str,
    high: str,
    width: float,
) -> DataFrame:
    """Pairs where ``low <= point <= high``, as an equi-join on steps of ``width``.

    Each range is listed once per step it covers, so pick a width near the usual length of
    a range. A crowded step is only a skewed join key, which AQE splits. Works on numbers;
    give times as seconds.
    """
    steps = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    cut = ranges.filter(F.col(low) <= F.col(high)).withColumn("__step", F.explode(steps))
    return (
        points.withColumn("__step", F.floor(F.col(point) / width))
        .join(cut, "__step")
        .filter(F.col(point).between(F.col(low), F.col(high)))
        .drop("__step")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], column: str, fractions: dict[str, float], bucket: Column | None = None
) -> DataFrame:
    """Interpolated quantiles per key, from counts of distinct values.

    Spark's own exact percentile holds all distinct values of a group in one task.
    """
    keys = list(keys)
    values = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    placed = with_measures(
        values, keys, [column], {"__upto": running_sum("__n"), "__total": total("__n")}, bucket
    )

    def holds(position: Column) -> Column:
        return (F.col("__upto") > position) & (F.col("__upto") - F.col("__n") <= position)

    wanted, outputs = F.lit(False), []
    for name, fraction in fractions.items():
        at = (F.col("__total") - 1) * F.lit(fraction)
        low, high = F.floor(at), F.ceil(at)
        wanted = wanted | holds(low) | holds(high)
        below = F.max(F.when(holds(low), F.col(column)))
        above = F.max(F.when(holds(high), F.col(column)))
        outputs.append((below + (above - below) * F.max(at - low)).alias(name))
    return placed.filter(wanted).groupBy(*keys).agg(*outputs)
