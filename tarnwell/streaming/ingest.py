"""Incremental ingest: a stream of fetched entities merged into a keyed table, a version for each batch.

Batch i makes version i + 1 from the one before and rewrites the buckets that its ids fall into; a batch that runs again
after a failure replaces its own version and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merging import upserted
from ..sources.keyed import KeyedTable, Manifest

BUCKETS = 64
#: The place of a row without one.
LAST = (1 << 62) - 1


def versions(spark: SparkSession, target: str) -> list[int]:
    return KeyedTable(spark, target).versions()


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest version, or None."""
    table = KeyedTable(spark, target)
    return table.read() if table.versions() else None


def _of_repeats(batch: DataFrame, key: str) -> DataFrame:
    """Of repeats in a batch the row with most reviews."""
    order = Window.partitionBy(key).orderBy(F.size("reviews").desc(), F.xxhash64(*(c for c in batch.columns if c != key)))
    return batch.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def merge_batch(batch: DataFrame, target: str, version: int, key: str = "id", keep: int = 2) -> Manifest:
    """Commits a version with the batch merged in; the last `keep` versions stay.

    Known entities are replaced by rows that have reviews and keep their place; new ones are added with or without, in the
    places after all others. Null ids are dropped.
    """
    table = KeyedTable(batch.sparkSession, target)
    new = _of_repeats(batch, key)
    placed = F.monotonically_increasing_id() + F.lit(version << 40)

    def combine(old: DataFrame, fetched: DataFrame) -> DataFrame:
        bare = fetched.where(F.coalesce(F.size("reviews"), F.lit(0)) <= 0).join(old.select(key), key, "left_anti").withColumn("ordinal", F.lit(LAST).cast("long"))
        merged = upserted(old, fetched).unionByName(bare)
        return merged.withColumn("ordinal", F.when(F.col("ordinal") == LAST, placed).otherwise(F.col("ordinal")))

    if any(v < version for v in table.versions()):
        done = table.merge(new, combine, version)
    else:
        done = table.create(new.withColumn("ordinal", placed), key, BUCKETS, again=True)
    table.cleaned(keep)
    return done


def merge_stream(entities: DataFrame, target: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    return entities.writeStream.foreachBatch(lambda batch, i: merge_batch(batch, target, i + 1, key) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
