"""Aggregates of rows that are never all put side by side."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Merged(NamedTuple):
    """An aggregate taken of parts: ``of`` a part's rows, ``again`` of what parts gave, ``both`` of two of those."""

    of: Column
    again: Callable[[Column | str], Column]
    both: Callable[[Column, Column], Column]


def counted() -> Merged:
    return Merged(F.count(F.lit(1)), F.sum, lambda a, b: F.coalesce(a + b, a, b))


def greatest(column: str) -> Merged:
    return Merged(F.max(column), F.max, F.greatest)


def taken(measures: dict[str, Merged]) -> list[Column]:
    return [m.of.alias(out) for out, m in measures.items()]


def merged(measures: dict[str, Merged]) -> list[Column]:
    """The aggregates that put rows of ``measures`` together, under their names."""
    return [m.again(out).alias(out) for out, m in measures.items()]
