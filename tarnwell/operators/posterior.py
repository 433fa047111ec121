"""Beta-Binomial posteriors of rating quality.

One pass over the reviews counts everything that any posterior needs; the posteriors are arithmetic on those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rnd, truthy

PRIOR = (2.0, 2.0)
Z = 1.96
THRESHOLDS = {"excellent": 4.5, "good": 3.5, "acceptable": 2.5}
SUB = {"clarity": 3.5, "helpfulness": 3.5, "difficulty": 1.5}
RETAKE_THRESHOLD = 3.0


def posterior(successes: Column, n: Column, threshold: float, prior: tuple[float, float] = PRIOR) -> Column:
    """struct of Beta(a + successes, b + failures): mean, variance, std and a normal interval clamped to [0, 1].

    Without observations: the prior, the interval [0, 1] and no std.
    """
    s, n = F.coalesce(successes, F.lit(0)), F.coalesce(n, F.lit(0))
    a, b = s + prior[0], n - s + prior[1]
    mean = a / (a + b)
    variance = a * b / ((a + b) * (a + b) * (a + b + 1.0))
    std = F.sqrt(variance)
    some = n > 0
    return F.struct(
        a.alias("alpha"),
        b.alias("beta"),
        rnd(mean, 4).alias("mean"),
        F.when(some, rnd(variance, 6)).otherwise(variance).alias("variance"),
        F.when(some, rnd(std, 4)).alias("std"),
        F.when(some, rnd(F.greatest(F.lit(0.0), mean - std * Z), 4)).otherwise(0.0).alias("ci_lower"),
        F.when(some, rnd(F.least(F.lit(1.0), mean + std * Z), 4)).otherwise(1.0).alias("ci_upper"),
        n.cast("long").alias("n_ratings"),
        s.cast("long").alias("n_above_threshold"),
        F.lit(threshold).alias("threshold"),
    )


def rating_counts(reviews: DataFrame, keys: tuple[str, ...] = ("entity_id",), more: Sequence[Column] = ()) -> DataFrame:
    """keys and the counts behind every posterior: one aggregation, partial before its shuffle. `more` aggregates join it.

    A review counts for the overall rating if both its ratings are present and not 0; a single rating of 0 is no rating.
    """
    clarity, helpful, difficulty = truthy("clarity"), truthy("helpful"), truthy("difficulty")
    overall = (clarity + helpful) / 2
    inverse = 5.0 - difficulty
    return reviews.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count(overall).alias("n_overall"),
        F.sum(overall).alias("sum_overall"),
        *(F.count_if(overall >= t).alias(f"n_{name}") for name, t in THRESHOLDS.items()),
        F.count(clarity).alias("n_clarity"),
        F.count_if(clarity >= SUB["clarity"]).alias("s_clarity"),
        F.sum(clarity).alias("sum_clarity"),
        F.count(helpful).alias("n_helpfulness"),
        F.count_if(helpful >= SUB["helpfulness"]).alias("s_helpfulness"),
        F.sum(helpful).alias("sum_helpfulness"),
        F.count(difficulty).alias("n_difficulty"),
        F.count_if(inverse >= SUB["difficulty"]).alias("s_difficulty"),
        F.sum(difficulty).alias("sum_difficulty"),
        F.count_if(F.col("would_take_again") == 1).alias("n_yes"),
        F.count_if(F.col("would_take_again") == 0).alias("n_no"),
        *more,
    )


def rating_posteriors() -> Column:
    return F.struct(*(posterior(F.col(f"n_{k}"), F.col("n_overall"), t).alias(k) for k, t in THRESHOLDS.items()))


def sub_rating(name: str) -> Column:
    """A sub-rating's posterior with the mean of the ratings as given; null where there is none."""
    n = F.col(f"n_{name}")
    p = posterior(F.col(f"s_{name}"), n, SUB[name])
    return F.when(n > 0, p.withField("raw_mean", rnd(F.col(f"sum_{name}") / n, 2)))


def retake_posterior() -> Column:
    n = F.col("n_yes") + F.col("n_no")
    return F.when(n > 0, posterior(F.col("n_yes"), n, RETAKE_THRESHOLD))


def long_posteriors(counts: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """One row for each key and threshold."""
    named = [F.struct(F.lit(k).alias("name"), posterior(F.col(f"n_{k}"), F.col("n_overall"), t).alias("p")) for k, t in THRESHOLDS.items()]
    return counts.select(*keys, F.explode(F.array(*named)).alias("x")).select(*keys, F.col("x.name").alias("level"), "x.p.*")
