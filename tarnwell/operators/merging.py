"""Incremental ingest: what is new, what is replaced, what a catalog has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unknown(found: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Found entities that are not known yet, one row for each id, with at least one rating."""
    fresh = found.where(F.col("num_ratings") > 0).dropDuplicates([key])
    return fresh.join(known.select(key), key, "left_anti")


def appended(known: DataFrame, new: DataFrame) -> DataFrame:
    return known.unionByName(new, allowMissingColumns=True)


def refetch_candidates(known: DataFrame, min_ratings: int = 3) -> DataFrame:
    """Known entities without reviews that ought to have some."""
    return known.where((F.coalesce(F.size("reviews"), F.lit(0)) <= 0) & (F.coalesce("num_ratings", F.lit(0)) >= min_ratings))


def to_fetch(found: DataFrame, known: DataFrame, key: str = "id", min_ratings: int = 3) -> DataFrame:
    """ids to fetch: those found that are unknown; only if there are none, the known ones that lack their reviews."""
    new = unknown(found, known, key).select(key)
    again = refetch_candidates(known, min_ratings).select(key)
    any_new = new.limit(1).agg(F.count(F.lit(1)).alias("fresh"))  # one row
    return new.unionByName(again.crossJoin(F.broadcast(any_new)).where("fresh = 0").select(key))


def upserted(known: DataFrame, fetched: DataFrame, key: str = "id") -> DataFrame:
    """known with rows replaced by fetched ones that have reviews; places stay, fetched ids that are new come last."""
    useful = fetched.where(F.size("reviews") > 0)
    columns = [c for c in known.columns if c != "ordinal"]
    k = known.select(F.col(key), F.col("ordinal"), F.struct(*columns).alias("old"))
    n = useful.select(F.col(key), F.struct(*columns).alias("new"))
    merged = k.join(n, key, "full_outer").select(F.coalesce("new", "old").alias("row"), "ordinal")
    return merged.select("row.*", F.coalesce("ordinal", F.lit((1 << 62) - 1)).cast("long").alias("ordinal"))


def catalog_status(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """catalog(slug, name) with status, professors and reviews from files(slug, readable, professors, reviews)."""
    status = F.when(F.col("readable").isNull(), "Not scraped").when(F.col("readable"), "Ready").otherwise("Error")
    return catalog.join(files, "slug", "left").select("slug", "name", status.alias("status"), F.when(status == "Ready", F.col("professors")).alias("professors"), F.when(status == "Ready", F.col("reviews")).alias("reviews")).orderBy("slug")


def selected(catalog: DataFrame, files: DataFrame, mode: str, slugs: list[str] | None = None) -> DataFrame:
    """The catalog rows of a bulk run: `missing` (no file yet), `refresh` (has one), `all`, or the given slugs."""
    if slugs:
        return catalog.where(F.col("slug").isin(*slugs))
    if mode == "all":
        return catalog
    if mode not in ("missing", "refresh"):
        raise ValueError(f"unknown mode {mode}")
    return catalog.join(files.select("slug"), "slug", "left_anti" if mode == "missing" else "left_semi")


def looked_up(catalog: DataFrame, slugs: list[str]) -> DataFrame:
    """The asked slugs in order with their catalog rows; `known` is false where the catalog has none."""
    asked = catalog.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(slugs))), "place int, slug string")
    rows = F.broadcast(asked).join(catalog.withColumn("known", F.lit(True)), "slug", "left")  # as long as the call's list
    return rows.withColumn("known", F.coalesce("known", F.lit(False))).orderBy("place")


def run_counters(outcomes: DataFrame) -> DataFrame:
    """outcomes(status) of a bulk run -> one row: succeeded, failed, skipped."""
    n = lambda s: F.count_if(F.col("status") == s)
    return outcomes.agg(n("Ready").alias("succeeded"), n("Error").alias("failed"), n("Not scraped").alias("skipped"))


def totals(entities: DataFrame) -> DataFrame:
    """total_professors, total_reviews."""
    return entities.agg(F.count(F.lit(1)).alias("total_professors"), F.coalesce(F.sum(F.greatest(F.coalesce(F.size("reviews"), F.lit(0)), F.lit(0))), F.lit(0)).alias("total_reviews"))


def first_by_place(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most `most` rows of each key, in order: the limits of an ingest."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rn") <= most).drop("rn")
