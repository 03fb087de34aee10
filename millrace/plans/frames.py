"""Frames of so many rows, for any aggregate, without one task for a key.

Rows are numbered within their key by the ordered plan and cut into cells of even size.
A frame reaches back over one cell border at most, so each cell gets copies of the rows
before it that its frames need, and an ordinary window runs over cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.ordered import row_number, with_measures

#: Rows of a cell, at least; a wider frame makes wider cells.
CELL = 1024
_NO, _CELL, _HOME = "__no", "__cell", "__home"


def row_frames(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], outputs: dict[str, Column], preceding: int, following: int = 0
) -> DataFrame:
    """Add ``outputs``, aggregates over the rows of the key from ``preceding`` before to ``following`` after each row.

    Each row is copied to at most one other cell on either side. Rows with NULL keys form
    a group of their own. Give an order without ties, as for any frame of rows.
    """
    if preceding < 0 or following < 0:
        raise ValueError("a frame holds its own row")
    size = max(CELL, preceding, following)
    numbered = with_measures(df, keys, order, {_NO: row_number()})
    cell, place = F.floor((F.col(_NO) - 1) / size), (F.col(_NO) - 1) % size
    # a row's own cell, the next one if frames there reach back to it, the one before if they reach on to it
    cells = F.array(cell, F.when(place >= size - preceding, cell + 1), F.when((place < following) & (cell > 0), cell - 1))
    copies = numbered.withColumn(_CELL, F.explode(F.filter(cells, lambda c: c.isNotNull()))).withColumn(_HOME, F.col(_CELL) == cell)
    frame = Window.partitionBy(*keys, _CELL).orderBy(_NO).rowsBetween(-preceding, following)
    framed = copies.select("*", *[c.over(frame).alias(name) for name, c in outputs.items()])
    return framed.filter(_HOME).select(*df.columns, *outputs)
