"""Joins on ranges and inequalities, without all pairs and without a width to guess.

Points are numbered in their order. How many points lie before a bound turns any range of
values into a range of numbers, and its length is the number of its matches. Numbers are
cut into cells of fixed size; a range is listed once for each cell it reaches, so it takes
part as often as its matches fill cells, and an equi-join on the cell finds them. A cell
holds few points however they are spread; a cell that many ranges reach is a skewed key on
the side of the ranges only, which AQE splits.

Where points that agree in some columns may be counted together, running measures over the
numbers give what a range open to one side holds of each kind: work goes with what is asked
for, ranges times kinds, not with the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.merging import Merged, taken
from millrace.plans.ordered import row_number, running, running_sum, with_measures
from millrace.session import written_table

#: Points of a cell.
CELL = 256
#: Points up to which a range reaches few cells, and listed ranges up to which Spark may broadcast them.
FEW, LISTED = 16 * CELL, 1 << 18
_AT, _SIDE, _ROW = "__at", "__side", "__row"


def _with_counts(points: DataFrame, rows: DataFrame, bound: str, after_equals: bool, out: str) -> DataFrame:
    """``rows`` with the number of points before their ``bound``, or up to it.

    Equal points and equal bounds are counted together before anything is sorted.
    """
    side = 2 if after_equals else 0
    asked = rows.select(F.col(bound).alias(_AT)).distinct().select(_AT, F.lit(side).alias(_SIDE), F.lit(0).cast("long").alias("__n"))
    placed = points.groupBy(_AT).agg(F.count(F.lit(1)).alias("__n")).withColumn(_SIDE, F.lit(1)).unionByName(asked)
    counted = with_measures(placed, [], [_AT, _SIDE], {out: running_sum("__n")})
    counts = counted.filter(F.col(_SIDE) == side).select(_AT, F.coalesce(out, F.lit(0)).alias(out))
    return rows.join(counts, F.col(bound) == F.col(_AT)).select(*rows.columns, out)


def _numbered_ranges(only: DataFrame, ranges: DataFrame, low: Column | None, high: Column | None, open_low: bool, open_high: bool) -> tuple[DataFrame, int]:
    """``ranges`` that hold any of the points ``only``, as the numbers after ``__from`` up to ``__to``; and how many points there are."""
    rows = ranges.select(F.struct("*").alias(_ROW), (F.lit(None) if low is None else low).alias("__low"), (F.lit(None) if high is None else high).alias("__high"))
    rows = rows.filter(" AND ".join([f"__{n} IS NOT NULL" for n, bound in (("low", low), ("high", high)) if bound is not None] or ["true"]))
    rows = rows.withColumn("__from", F.lit(0).cast("long")) if low is None else _with_counts(only, rows, "__low", open_low, "__from")
    n = only.count()
    rows = rows.withColumn("__to", F.lit(n).cast("long")) if high is None else _with_counts(only, rows, "__high", not open_high, "__to")
    return rows.filter("__from < __to"), n


def points_in_ranges(
    points: DataFrame, ranges: DataFrame, point: Column, low: Column | None, high: Column | None, open_low: bool = False, open_high: bool = False
) -> DataFrame:
    """Pairs (``points``, ``ranges``), a struct each, with ``low <= point <= high``.

    A bound that is None leaves that side open; ``open_low`` and ``open_high`` leave equal
    values out. NULL points and rows with a NULL bound have no match. All three
    expressions must be of one type. Repeated rows are pairs of their own.
    """
    numbered = points.select(point.alias(_AT), F.struct("*").alias("points")).filter(F.col(_AT).isNotNull())
    rows, n = _numbered_ranges(numbered.select(_AT), ranges, low, high, open_low, open_high)
    first, last = F.floor(F.col("__from") / CELL), F.floor((F.col("__to") - 1) / CELL)
    reached = rows.withColumn("__cell", F.explode(F.sequence(first, last)))
    # Spark's estimate does not see how often a range is listed: a broadcast would hold all of it.
    if n > FEW and (rows.agg(F.sum(last - first + 1)).first()[0] or 0) > LISTED:
        reached = reached.hint("merge")
    placed = with_measures(numbered, [], [_AT], {"__no": row_number()}).withColumn("__cell", F.floor((F.col("__no") - 1) / CELL))
    pairs = placed.join(reached, "__cell").filter((F.col("__no") > F.col("__from")) & (F.col("__no") <= F.col("__to")))
    return pairs.select("points", F.col(_ROW).alias("ranges"))


def measures_of_ranges(
    points: DataFrame, ranges: DataFrame, point: Column, low: Column | None, high: Column | None, is_open: bool, by: list[str], measures: dict[str, Merged]
) -> DataFrame:
    """The pairs of ``points_in_ranges``, those of one range whose points agree in ``by`` put together.

    ``points`` is a struct of ``by`` and the ``measures`` of the points. One bound has to be None.
    Values are numbered from that side on, so a range is its number of values and takes what the
    values of a ``by`` come to so far. Equal points and equal ranges are looked at once.
    """
    kept = points.withColumn(_AT, point).filter(F.col(_AT).isNotNull()).groupBy(_AT, *by).agg(*taken(measures))
    values = kept.select(_AT).distinct()
    rows, n = _numbered_ranges(values, ranges, low, high, is_open, is_open)
    up = low is None
    rows = rows.withColumn("__reach", F.col("__to") if up else F.lit(n) - F.col("__from"))
    numbers = with_measures(values, [], [_AT], {"__no": row_number()})
    step = F.col("__no") if up else F.lit(n + 1) - F.col("__no")
    met = written_table(kept.join(numbers, _AT).select(*by, step.alias("__step"), F.lit(1).alias(_SIDE), *measures))
    # Only a range that gets as far as a by's nearest value asks for it.
    nearest = met.groupBy(*by).agg(F.min("__step").alias("__step"))
    asked = points_in_ranges(rows.select("__reach").distinct(), nearest, F.col("__reach"), F.col("__step"), None)
    asked = asked.select(*[F.col("ranges")[c].alias(c) for c in by], F.col("points.__reach").alias("__step"), F.lit(2).alias(_SIDE))
    sums = {f"__upto_{out}": running(out, m) for out, m in measures.items()}
    swept = with_measures(met.unionByName(asked, allowMissingColumns=True), by, ["__step", _SIDE], sums).filter(F.col(_SIDE) == 2)
    found = swept.select(F.col("__step").alias("__reach"), F.struct(*by, *[F.col(f"__upto_{out}").alias(out) for out in measures]).alias("points"))
    return rows.join(found, "__reach").select("points", F.col(_ROW).alias("ranges"))


def overlap_join(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str]) -> DataFrame:
    """Pairs (``left``, ``right``), a struct each, of ranges that have a value in common, ends included.

    Of two ranges that overlap one starts inside the other: either the right one does, or
    the left one does and later, so every pair is found once. A range with a NULL end or
    whose end comes before its start overlaps nothing.
    """
    (a, b), (c, d) = ([F.col(f"`{n}`") for n in names] for names in (left_bounds, right_bounds))
    left, right = left.filter(a <= b), right.filter(c <= d)
    later = points_in_ranges(right, left, c, a, b).select(F.col("ranges").alias("left"), F.col("points").alias("right"))
    earlier = points_in_ranges(left, right, a, c, d, open_low=True).select(F.col("points").alias("left"), F.col("ranges").alias("right"))
    return later.unionByName(earlier)


def inequality_join(
    left: DataFrame, right: DataFrame, on: tuple[str, str, str], by: list[str] | None = None, measures: dict[str, Merged] | None = None
) -> DataFrame:
    """Pairs (``left``, ``right``), a struct each, for which ``on`` holds, such as ``("a", "<", "b")``.

    ``left.a`` stands left of the sign, ``right.b`` right of it; NULL compares with
    nothing. The work goes with the number of pairs, so further conditions filter what
    comes out and cost what they throw away.

    With ``measures``, the right rows a left row meets come together where they agree in ``by``:
    ``right`` holds ``by`` and the measures of those rows. All pairs count, but none is listed by
    itself, so conditions may ask for ``by`` only, and the work goes with left rows times values of ``by``.
    """
    name, sign, other = on
    bound = F.col(f"`{name}`")
    sides = {"<": (bound, None, True), "<=": (bound, None, False), ">": (None, bound, True), ">=": (None, bound, False)}
    if sign not in sides:
        raise ValueError(f"no inequality: {sign}")
    low, high, strict = sides[sign]
    given = (right, left, F.col(f"`{other}`"), low, high, strict)
    pairs = points_in_ranges(*given, strict) if measures is None else measures_of_ranges(*given, by or [], measures)
    return pairs.select(F.col("ranges").alias("left"), F.col("points").alias("right"))
