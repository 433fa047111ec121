"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], w(t) proportional to 1 + a - 2at. Its integral
W(t) = (1 + a)t - at^2 says which share of the source's target has been asked for by time t. Documents lie end to end in
a fixed shuffled order, epoch after epoch; inverting W at a document's cumulative share gives the time at which training
reaches it, every epoch's copy of it at a time of its own, and the documents are range-sorted by that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, n_words, running_sums, saved, table

WEIGHTS = (1, 2, 3)
MOST = 3
#: Rows that one bucket of the shuffled order holds on average in a table of one source.
BUCKET_ROWS = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(source, size) -> (source, source_size, rank, target double).

    Sources in code point order, null last, weigh `weights` in turn and share the sum of all sizes; a target stops at
    `most` times its source's size and the excess is shared anew by weight. With sources in order of limit per unit of
    weight, the level that the rest shares is the largest of what is left after capping the first k, over k.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    each = running_sums(each, ("none", "source"), {"rank": F.lit(1)}).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    each = each.withColumn("limit", F.col("source_size") * most / F.col("weight"))
    each = running_sums(each, ("limit", "rank"), {"full": F.col("source_size") * most, "full_weight": F.col("weight")})
    whole = each.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("all_weight"))
    each = each.crossJoin(F.broadcast(whole)).withColumn("level", (F.col("all") - F.col("full")) / (F.col("all_weight") - F.col("full_weight")))  # one row
    level = each.crossJoin(F.broadcast(each.agg(F.max("level").alias("top"))))  # one row
    return level.select("source", "source_size", "rank", F.least((F.col("source_size") * most).cast("double"), F.col("weight") * F.col("top")).alias("target"))


def _time(asked: Column, rank: Column) -> Column:
    """The time by which a share `asked` of a source's target has been asked for: W inverted."""
    a = (rank % 3 - 1) / 2.0
    return 2.0 * asked / ((1.0 + a) + F.sqrt((1.0 + a) * (1.0 + a) - 4.0 * a * asked))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), whole: bool = False, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs(doc_id, text, source) -> `keep`, size, source_size, target, taken, copies, position, positions; one row per row.

    size: words of the text, null: 0. taken: words the mix takes of the document over all epochs; the last document of a
    source's share is cut there, or, if `whole`, goes in whole if at least half of it would. copies: epochs that take
    some of it (an empty document: 1 in the first epoch). positions: the times at which its copies are reached, in order;
    position: the first of them, null if not taken in the first epoch. Order within a source: md5 of the id and of the
    text's md5, ties by id and size, so reruns agree; rows that tie in all of these are interchangeable. Null ids, repeated
    ids and very long texts are rows like any other. A null source is a source of its own; an empty table gives an empty table.

    A source's order is cut into hash buckets, so that running sums need no task that holds a whole source. Only rows equal
    in id and text share a bucket whatever its size.
    """
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    each = saved(docs.select(F.struct(*keep).alias("row"), F.col("doc_id").alias("id"), source.alias("key"), n_words("text").alias("size"), F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).cast("binary")).alias("h")))
    digits = 1
    rows = each.count()
    while 16**digits * BUCKET_ROWS < rows:
        digits += 1
    each = each.withColumn("bucket", F.substring("h", 1, digits))
    sums = each.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
    named = sums.select(F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30)).alias("source"), F.col("words").alias("size"))
    goal = targets(named, weights, most).withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    sums = sums.select("key", "bucket", "base").join(goal, "key")
    inside = Window.partitionBy("key", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.join(sums, ["key", "bucket"]).withColumn("at", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    left = [F.floor(F.col("target") + 0.5) - F.col("source_size") * e - F.col("at") for e in range(most)]
    zero, size = F.lit(0).cast("long"), F.col("size")
    if whole:
        part = [F.when((2 * x >= size) & (x >= 0), size).otherwise(zero) for x in left]
        copy = [F.when((2 * x >= size) & (x >= 0) & ((size > 0) | F.lit(e == 0)), 1).otherwise(0) for e, x in enumerate(left)]
    else:
        part = [F.greatest(zero, F.least(x, size)) for x in left]
        copy = [F.when((x > 0) & (size > 0) | (x >= 0) & (size == 0) & F.lit(e == 0), 1).otherwise(0) for e, x in enumerate(left)]
    total = lambda xs: sum(xs[1:], xs[0])
    asked = lambda e: F.coalesce(F.try_divide((F.col("at") + F.col("source_size") * e).cast("double"), F.col("target")), F.lit(0.0))
    times = [F.when(c > 0, _time(F.least(asked(e), F.lit(1.0)), F.col("rank"))) for e, c in enumerate(copy)]
    return placed.select(
        *(F.col("row")[k].alias(k) for k in keep), "size", "source_size", "target", total(part).cast("long").alias("taken"),
        total(copy).alias("copies"), times[0].alias("position"), F.array_compact(F.array(*times)).alias("positions"),
    )


def op6_mix_sources(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, 1 + r % 3 AS weight FROM s),
f AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
  FROM w WINDOW before AS (ORDER BY (3 * source_size) / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT source, source_size, r,
         least(CAST(3 * source_size AS DOUBLE), weight * max(CAST(words_left AS DOUBLE) / CAST(weight_left AS DOUBLE)) OVER ()) AS target
  FROM f),
p AS (
  SELECT doc_id, size, source_size, target, (r % 3 - 1) / 2.0::DOUBLE AS a, CAST(floor(target + 0.5) AS BIGINT) AS goal,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, CASE WHEN target = 0 THEN 0 ELSE least(before::DOUBLE / target, 1.0::DOUBLE) END AS asked FROM p)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(goal - before, size)) + greatest(0, least(goal - source_size - before, size))
            + greatest(0, least(goal - 2 * source_size - before, size)) AS BIGINT) AS taken,
       CASE WHEN goal > before OR (size = 0 AND goal >= before)
            THEN 2.0::DOUBLE * asked / ((1.0::DOUBLE + a) + sqrt((1.0::DOUBLE + a) * (1.0::DOUBLE + a) - 4.0::DOUBLE * a * asked)) END AS position
FROM q
"""
