"""Sketches that are stored once and merged on read: distinct counts and quantiles without a rescan.

A table of sketches has a row for each group, such as a day and a kind. Sketches of any
groups merge into that of all their rows, so a report over a year reads a few hundred rows
instead of the year's data, and a new day adds its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of a distinct sketch's buckets: its relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Size of a quantile sketch: its ranks are within about 1.7 percent at this size, nearly always.
QUANTILE_K = 200
ROWS = "n_rows"


def build_sketches(df: DataFrame, by: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = ()) -> DataFrame:
    """One row for each group: ``n_rows`` and a sketch for each column. NULLs are in no sketch."""
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), LG_K).alias(f"distinct_{c}") for c in distinct]
    sketches += [F.kll_sketch_agg_double(F.col(c).cast("double"), QUANTILE_K).alias(f"quantiles_{c}") for c in quantiles]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(ROWS), *sketches)


def read_sketches(sketches: DataFrame, by: Sequence[str], fractions: dict[str, float] | None = None) -> DataFrame:
    """Estimates for coarser groups: ``n_rows``, ``distinct_<column>`` and ``<column>_<name>`` for each fraction.

    ``fractions`` names the quantiles. Where a group has no values they are NULL.
    """
    distinct = [c for c in sketches.columns if c.startswith("distinct_")]
    quantiles = [c for c in sketches.columns if c.startswith("quantiles_")]
    merged = sketches.groupBy(*by).agg(
        F.sum(ROWS).alias(ROWS), *[F.hll_union_agg(c).alias(c) for c in distinct], *[F.kll_merge_agg_double(c).alias(c) for c in quantiles]
    )
    outputs = [F.hll_sketch_estimate(c).alias(c) for c in distinct]
    for c in quantiles:
        for name, fraction in (fractions or {}).items():
            filled = F.kll_sketch_get_n_double(c) > 0
            outputs.append(F.when(filled, F.kll_sketch_get_quantile_double(c, F.lit(fraction))).alias(f"{c.removeprefix('quantiles_')}_{name}"))
    return merged.select(*by, ROWS, *outputs)
