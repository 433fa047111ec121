"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    return row[0], row[1] or 0


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, component): each linked node with the smallest node it can reach.

    Alternates large-star and small-star steps until the links are stars around each component's minimum.
    A hub is met with a partial minimum and a join on its key, which adaptive execution splits; no step gathers a
    node's neighbours. Rounds grow with the logarithm of the longest path. Self-links and repeats are ignored, null
    ends dropped; nodes without links are absent; no links give an empty table.
    """
    a, b = F.col("a"), F.col("b")
    edges = cut(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = cut(small.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(a.alias("node"), b.alias("component")).unionByName(edges.select(b.alias("node"), b.alias("component")).distinct())
