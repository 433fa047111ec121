"""Totals at several levels in one pass: grouping sets, cube, rollup.

`level` has a bit for each key, the first one highest, that is 1 where the row is a total over that key; so a null key is
told from a total. Each input row becomes one row for each set before anything is shuffled, and those are aggregated
within the task: what is shuffled is a row for each group and task, a grand total too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shown(grouped, by: tuple[str, ...], aggregates: dict[str, Column]) -> DataFrame:
    level = F.grouping_id(*by).cast("long").alias("level")
    return grouped.agg(level, *(c.alias(n) for n, c in aggregates.items())).select(*by, "level", *aggregates)


def cube(df: DataFrame, by: tuple[str, ...], aggregates: dict[str, Column]) -> DataFrame:
    return _shown(df.cube(*by), by, aggregates)


def rollup(df: DataFrame, by: tuple[str, ...], aggregates: dict[str, Column]) -> DataFrame:
    return _shown(df.rollup(*by), by, aggregates)


def grouping_sets(df: DataFrame, by: tuple[str, ...], sets: tuple[tuple[str, ...], ...], aggregates: dict[str, Column]) -> DataFrame:
    """The given sets of keys only; the empty set is the grand total."""
    unknown = {k for s in sets for k in s} - set(by)
    if unknown:
        raise ValueError(f"not among the keys: {', '.join(sorted(unknown))}")
    return _shown(df.groupingSets([[F.col(k) for k in s] for s in sets], *by), by, aggregates)
