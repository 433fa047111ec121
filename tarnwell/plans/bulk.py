"""A bulk run over the catalog: choose schools, fetch, merge, analyze, write, count. Each step is one job for all schools."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stored import cut
from ..operators import merging
from ..sources import remote, schools
from ..sources.keyed import KeyedTable
from .analyze import analyze


@dataclass(frozen=True)
class Service:
    """Where schools, entities and reviews come from, and how fast they may be asked for."""

    url: str
    search: str
    listing: str
    reviews: str
    search_path: str = "newSearch.schools"
    listing_path: str = "search.teachers"
    reviews_path: str = "node.ratings"
    tasks: int = 8
    pace: float = 0.0
    limited_wait: int = 1
    terms: tuple[str, ...] = tuple(remote.search_terms())

    def ask(self, rows: DataFrame, key: Column, query: str, path: str, most: int | None = None, **variables: Column) -> DataFrame:
        pairs = [x for name, value in variables.items() for x in (F.lit(name), value)]
        return remote.fetched(rows.select(key.alias("key"), F.create_map(*pairs).alias("variables")), self.url, query, path, self.tasks, most, self.pace, self.limited_wait)


def analyzed_files(spark: SparkSession, root: str) -> DataFrame:
    """slug, readable, professors, reviews of the schools that have been analyzed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/analyzed")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "slug string, readable boolean, professors long, reviews long")
    rows = spark.read.parquet(f"{root}/analyzed")
    return rows.groupBy(F.col("school").alias("slug")).agg(F.lit(True).alias("readable"), F.count(F.lit(1)).alias("professors"), F.sum("n_overall").alias("reviews"))


def with_ids(chosen: DataFrame, service: Service) -> DataFrame:
    """chosen(slug, name, school_id, most) with the ids that are missing found by name: the service's first hit."""
    hits = service.ask(chosen.where("school_id IS NULL"), F.col("slug"), service.search, service.search_path, 1, text=F.col("name"))
    first = hits.select(F.col("key").alias("slug"), F.col("id").alias("hit"))
    return chosen.join(first, "slug", "left").select("slug", "name", F.coalesce("school_id", "hit").alias("school_id"), "most")


def fetch(chosen: DataFrame, known: DataFrame | None, service: Service) -> DataFrame:
    """slug, id, professor columns, nested reviews of what is worth fetching for chosen(slug, school_id, most).

    Entities count once however many terms find them; of a school's with ratings the first `most` by id are taken. Of those
    only unknown ones are fetched; for a school without any, the known ones (slug, id, num_ratings, reviews) that lack reviews.
    """
    terms = chosen.where("school_id IS NOT NULL").select("slug", "school_id", F.explode(F.array(*map(F.lit, service.terms))).alias("term"))
    nodes = service.ask(terms, F.col("slug"), service.listing, service.listing_path, text=F.col("term"), schoolID=F.col("school_id"))
    listed = schools.from_listing(schools.parsed(nodes.withColumnRenamed("key", "slug")), "slug").where("num_ratings > 0 AND id IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("slug").orderBy("id"))
    first = listed.dropDuplicates(["slug", "id"]).join(chosen.select("slug", "most"), "slug").withColumn("place", place).where("place <= most")
    found = cut(first.drop("place", "most"))  # the answers of the service, which are not asked for again
    if known is not None:
        fresh = found.join(known.select("slug", "id"), ["slug", "id"], "left_anti").select("slug", "id")
        again = merging.refetch_candidates(known).select("slug", "id").join(fresh.select("slug").distinct(), "slug", "left_anti")
        found = found.join(fresh.unionByName(again), ["slug", "id"], "left_semi")
    answers = service.ask(found, F.col("id"), service.reviews, service.reviews_path, id=F.col("id"))
    reviews = schools.review_rows(schools.parsed(answers.withColumnRenamed("key", "professor_id"), schools.REVIEW_NODE), "professor_id", "place")
    return cut(schools.with_reviews(found, reviews))


def _combined(old: DataFrame, new: DataFrame) -> DataFrame:
    """Known rows are replaced by fetched ones that have reviews; new rows are added with or without."""
    useful = new.where(F.size("reviews") > 0).unionByName(new.where(F.size("reviews") <= 0).join(old.select("id"), "id", "left_anti"))
    return old.join(useful.select("id"), "id", "left_anti").unionByName(useful.select(*old.columns))


def documents(raw: DataFrame) -> DataFrame:
    """slug, id, .. rows as one raw document for each school, entities in the order of ids; a school has `most` of them."""
    names = [c for c in raw.columns if c != "slug"]
    listed = F.array_sort(F.collect_list(F.struct(*names)), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    return raw.groupBy(F.col("slug").alias("school")).agg(listed.alias("professors"))


def bulk_run(spark: SparkSession, catalog: DataFrame, root: str, service: Service, as_of: str, mode: str = "missing", slugs: list[str] | None = None) -> DataFrame:
    """catalog(slug, name, school_id, most) -> slug, name, status, professors, reviews of the schools of this run.

    `mode` and `slugs` choose as merging.selected does. Under root lie `raw`, a keyed table of what was fetched, and
    `analyzed`, of which only the chosen schools' partitions are rewritten. A school that brings nothing is an Error;
    merging.run_counters counts the outcomes.
    """
    chosen = cut(with_ids(merging.selected(catalog, analyzed_files(spark, root), mode, slugs), service))
    table = KeyedTable(spark, f"{root}/raw")
    known = table.read().join(chosen.select("slug"), "slug", "left_semi") if table.versions() else None
    new = fetch(chosen, known, service).dropDuplicates(["id"])
    if table.versions():
        table.merge(new, _combined)
    else:
        table.create(new, "id")
    docs = documents(table.read().join(chosen.select("slug"), "slug", "left_semi"))
    done = analyze(schools.entities(docs), schools.reviews(docs), as_of)
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("school").parquet(f"{root}/analyzed")
    files = analyzed_files(spark, root)
    tried = chosen.join(files, "slug", "left").select("slug", F.coalesce("readable", F.lit(False)).alias("readable"), "professors", "reviews")
    return merging.catalog_status(chosen.select("slug", "name"), tried)
