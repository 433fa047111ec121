"""What a graph's nodes reach within some steps, frontier by frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import cut

STEPS = 4


def reached(edges: DataFrame, starts: DataFrame, steps: int = STEPS) -> DataFrame:
    """node, steps (the least number of them) of every node within `steps` steps of a start; starts have 0.

    edges(a, b) are followed from a to b; starts(node). Cycles end where they come back to what was reached; null nodes are
    nobody. Only the frontier is joined with the edges, each is kept as a stored table of its own, and no path is kept, so
    the work of a step is that of the frontier's edges. Ends early once nothing new is reached.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    frontier = cut(starts.where("node IS NOT NULL").select("node").distinct().withColumn("steps", F.lit(0).cast("long")))
    seen = frontier
    for k in range(1, steps + 1):
        found = edges.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        frontier = cut(found.join(seen.select("node"), "node", "left_anti").withColumn("steps", F.lit(k).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
