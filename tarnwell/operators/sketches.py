"""Sketches that are stored by day and merged: distinct counts (HyperLogLog) and quantiles (KLL).

A sketch of many days is made from the sketches of the days; no row is read again. A new day is one more row of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers as a power of two; a distinct count is off by 1.04 / sqrt(registers) for one standard deviation.
REGISTERS = 12
#: The size of a quantile sketch; a rank is off by less than RANK_ERROR with 99 % confidence, merged or not.
K = 400
RANK_ERROR = 0.0133 / 2
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Standard deviations within which an estimate counts as good.
SIGMAS = 4


def daily(rows: DataFrame, ts: str, by: tuple[str, ...], distinct: str, measure: str) -> DataFrame:
    """day, `by`, n, users (HyperLogLog of `distinct`), values (KLL of the whole number `measure`); nulls enter neither."""
    return rows.groupBy(F.to_date(ts).alias("day"), *by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, F.lit(REGISTERS)).alias("users"), F.kll_sketch_agg_bigint(measure, F.lit(K)).alias("values"))


def merged(days: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The same over all days of `by`."""
    return days.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_bigint("values").alias("values"))


def distinct_count() -> Column:
    return F.hll_sketch_estimate("users")


def quantile(q: float) -> Column:
    """The smallest value at or below which a share q of the values lies."""
    return F.kll_sketch_get_quantile_bigint("values", F.lit(q))


def compared(rows: DataFrame, sketched: DataFrame, by: tuple[str, ...], distinct: str, measure: str) -> DataFrame:
    """`by`, users and n exact, and whether the sketches are within their bounds: SIGMAS deviations, RANK_ERROR of rank.

    The rank of an estimated quantile is counted: the share of values below it and the share at or below it must enclose
    the quantile, but for the error.
    """
    estimates = sketched.select(*by, distinct_count().alias("estimate"), *(quantile(q).alias(f"q{k}") for k, q in enumerate(QUANTILES)))
    both = rows.join(F.broadcast(estimates), list(by))  # a row for each group
    ranks = [F.count_if(F.col(measure) < F.col(f"q{k}")).alias(f"below{k}") for k in range(len(QUANTILES))]
    ranks += [F.count_if(F.col(measure) <= F.col(f"q{k}")).alias(f"upto{k}") for k in range(len(QUANTILES))]
    exact = both.groupBy(*by).agg(F.count_distinct(distinct).alias("users"), F.count(F.lit(1)).alias("n"), F.count(measure).alias("valued"), F.first("estimate").alias("estimate"), *ranks)
    off = SIGMAS * 1.04 / 2 ** (REGISTERS / 2)
    good = F.lit(True)
    for k, q in enumerate(QUANTILES):
        good = good & (F.col(f"below{k}") / F.col("valued") - RANK_ERROR <= q) & (F.col(f"upto{k}") / F.col("valued") + RANK_ERROR >= q)
    return exact.select(*by, "users", "n", (F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * off)).alias("users_within"), good.alias("quantiles_within"))
