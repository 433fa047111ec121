"""The star-schema test tables read as entities and reviews.

A supplier is an entity, its nation the department; each of its line items is a review. All expressions are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..operators.posterior import rating_counts

#: Outcomes that line items are dealt.
GRADES = ("A+", "A", "A-", "B+", "B", "C", "D", "F", "Not sure yet")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, classes: bool = False) -> DataFrame:
    """entity_id, review_ordinal, clarity, helpful, difficulty, would_take_again, grade, date, thumbs_up, thumbs_down,
    doc_key, and with `classes` class_name, which costs a join.

    review_ordinal is an entity's document order; it follows from a line item's own keys, so no sort numbers the rows.
    """
    line = read(spark, sf_dir, "lineitem")
    if classes:
        line = line.join(read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("class_name")), F.col("l_partkey") == F.col("p_partkey"))
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("int")
    return line.select(
        F.col("l_suppkey").alias("entity_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("review_ordinal"),
        *(["class_name"] if classes else []),
        (1 + F.floor((F.col("l_quantity") - 1) / 10).cast("int")).cast("double").alias("clarity"),
        (1 + F.col("l_partkey") % 5).cast("double").alias("helpful"),
        (1 + F.least(F.lit(4), F.floor(cents("l_discount") / 2).cast("int"))).cast("double").alias("difficulty"),
        F.when(F.col("l_linenumber") == 7, None).when(F.col("l_linestatus") == "O", 1).when(F.col("l_linestatus") == "F", 0).alias("would_take_again"),
        F.element_at(F.array(*map(F.lit, GRADES)), (1 + F.col("l_orderkey") % 9).cast("int")).alias("grade"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.col("l_linenumber").alias("thumbs_up"),
        cents("l_tax").alias("thumbs_down"),
        F.col("l_orderkey").alias("doc_key"),
    )


def entities(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    """school, ordinal, entity_id, legacy_id, name, department, the source's averages, and the counts of its reviews."""
    counts = rating_counts(reviews(spark, sf_dir)) if counts is None else counts
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("department"))
    suppliers = read(spark, sf_dir, "supplier").join(nations, "s_nationkey", "left")
    base = suppliers.select(F.lit("testdata").alias("school"), F.col("s_suppkey").alias("ordinal"), F.col("s_suppkey").alias("entity_id"), F.col("s_suppkey").alias("legacy_id"), F.col("s_name").alias("name"), "department")
    asked = F.col("n_yes") + F.col("n_no")
    return base.join(counts, "entity_id", "left").select(
        *base.columns,
        rnd(F.col("sum_overall") / F.nullif("n_overall", F.lit(0)), 2).alias("avg_rating"),
        rnd(F.col("sum_difficulty") / F.nullif("n_difficulty", F.lit(0)), 2).alias("avg_difficulty"),
        F.coalesce("n_reviews", F.lit(0)).alias("num_ratings"),
        F.when(asked > 0, rnd(F.col("n_yes") / asked * 100, 1)).otherwise(-1.0).alias("would_take_again_pct"),
        *(c for c in counts.columns if c != "entity_id"),
    )


def documents_as_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("comment"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, top_tags: how often each return flag and status occurs among an entity's line items, most frequent first."""
    tag = F.concat_ws(" ", "l_returnflag", "l_linestatus")
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id"), tag.alias("tag")).agg(F.count(F.lit(1)).alias("count"))
    lists = counts.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), "tag", "count"))).alias("x"))
    return lists.select("entity_id", F.transform("x", lambda t: F.struct(t["tag"].alias("tag"), t["count"].alias("count"))).alias("top_tags"))
