"""Joins in time: the last earlier row (as-of), and all rows within an interval, without products of the two sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of one key that a task sorts at once.
STRETCH = 86_400


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def bucket(at: str, width: int) -> Column:
    """The number of the stretch of `width` microseconds that a time lies in, times before 1970 included."""
    return F.expr(f"({at} - pmod({at}, {width}L)) div {width}L")


def _null_of(df: DataFrame, column: Column) -> Column:
    return F.lit(None).cast(df.select(column.alias("c")).schema["c"].dataType)


def asof(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, columns: dict[str, str], order: tuple[str, ...] = (), strict: bool = False, within: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """left with `columns` (name in right -> name in the result) of the last row of right that has its `on` and is no later.

    A left join: without such a row the columns are null. `strict` asks for an earlier row, `within` for one that is at most
    so many seconds earlier. Of right rows at one time the last by `order` counts. Null keys and times find nothing. Rows of
    left keep their number, repeated ones too.

    Both sides are sorted once, as one: by time, right rows before left ones, and the last right row is carried on. A key's
    rows are sorted by stretches of `stretch` seconds, so a key with a third of all rows is many groups; a stretch begins
    with the last right row of the stretches before it, of which there is one for each stretch that has rows.
    """
    row = F.struct(*(F.col(c) for c in left.columns))
    found = F.struct(micros(right_ts).alias("at"), *(F.col(c).alias(n) for c, n in columns.items()))
    tie = F.struct(*(F.col(c) for c in order)) if order else F.lit(0)
    # at one time a right row comes before a left one, or after it where only earlier ones count
    mine, theirs = (1, 2) if strict else (2, 1)
    usable = F.col(on).isNotNull() & F.col(left_ts).isNotNull()
    one = left.where(usable).select(F.col(on).alias("k"), micros(left_ts).alias("at"), F.lit(mine).alias("side"), _null_of(right, tie).alias("tie"), row.alias("row"), _null_of(right, found).alias("found"))
    two = right.where(F.col(on).isNotNull() & F.col(right_ts).isNotNull()).select(F.col(on).alias("k"), micros(right_ts).alias("at"), F.lit(theirs).alias("side"), tie.alias("tie"), _null_of(left, row).alias("row"), found.alias("found"))
    both = one.unionByName(two).withColumn("b", bucket("at", stretch * 1_000_000))

    last = F.max_by(F.struct("at", "tie", "found"), F.when(F.col("side") == theirs, F.struct("at", "tie"))).alias("last")
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    carried = both.groupBy("k", "b").agg(last).select("k", "b", before.alias("c")).where("c IS NOT NULL")
    carried = carried.select("k", F.col("c.at").alias("at"), F.lit(0).alias("side"), F.col("c.tie").alias("tie"), _null_of(left, row).alias("row"), F.col("c.found").alias("found"), "b")
    # the carried row is first of its stretch, whatever its own time
    upto = Window.partitionBy("k", "b").orderBy(F.least("side", F.lit(1)), "at", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.unionByName(carried).withColumn("found", F.last("found", ignorenulls=True).over(upto)).where("row IS NOT NULL")
    if within is not None:
        joined = joined.withColumn("found", F.when(F.col("at") - F.col("found.at") <= within * 1_000_000, F.col("found")))
    rest = left.where(~usable).select(*left.columns, *(F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in columns.items()))
    return joined.select("row.*", *(f"found.{n}" for n in columns.values())).unionByName(rest)


def within_interval(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, columns: dict[str, str], before: int, after: int, how: str = "inner") -> DataFrame:
    """left with `columns` of every right row of its `on` from `before` seconds before its time to `after` seconds after it.

    Both ends count; negative numbers shift the interval. `how` is inner or left; null keys and times pair with nothing.
    Rows of both sides count each time.

    Time is cut into buckets as long as the interval. A left row stands in the bucket where its interval begins; a right
    row stands in its own bucket and the one before, so that the two meet once. The join is on key and bucket: a key of many
    rows is many join keys, and what is still uneven is left to Spark's skew join.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join {how}")
    if before + after < 0:
        raise ValueError("the interval ends before it begins")
    width = max(1, (before + after) * 1_000_000)
    asked = left.select(F.struct(*(F.col(c) for c in left.columns)).alias("row"), F.col(on).alias("k"), (micros(left_ts) - before * 1_000_000).alias("low"))
    asked = asked.withColumn("b", bucket("low", width))
    found = right.where(F.col(on).isNotNull() & F.col(right_ts).isNotNull())
    found = found.select(F.col(on).alias("k"), micros(right_ts).alias("at"), F.struct(*(F.col(c).alias(n) for c, n in columns.items())).alias("found"))
    found = found.withColumn("b", F.explode(F.array(bucket("at", width), bucket("at", width) - 1)))
    length = (before + after) * 1_000_000
    met = (asked["k"] == found["k"]) & (asked["b"] == found["b"]) & (found["at"] >= asked["low"]) & (found["at"] <= asked["low"] + F.lit(length))
    return asked.join(found, met, how).select("row.*", *(f"found.{n}" for n in columns.values()))
