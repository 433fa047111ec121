"""Nested school documents: schemas, readers, writers, discovery, and a small cache of read schools."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "school_name string, school_id string, city string, state string, scraped_at string, total_professors bigint, total_reviews bigint, analyzed_at string"
REVIEW = (
    "id string, class_name string, date string, comment string, helpful_rating double, clarity_rating double, difficulty_rating double, rating_tags string, "
    "would_take_again int, grade string, is_online boolean, is_for_credit boolean, attendance_mandatory string, thumbs_up int, thumbs_down int"
)
PROFESSOR = (
    "id string, legacy_id bigint, first_name string, last_name string, department string, avg_rating double, avg_difficulty double, num_ratings bigint, "
    f"would_take_again_pct double, top_tags array<struct<tag:string,count:bigint>>, reviews array<struct<{', '.join(p.replace(' ', ':', 1) for p in REVIEW.split(', '))}>>"
)


def _struct(fields: str) -> str:
    """A list of `name type` fields as a struct type; commas inside types stay."""
    out, depth, field = [], 0, ""
    for c in fields + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            field = ""
        else:
            field += c
    return f"struct<{','.join(out)}>"


RAW = f"metadata {_struct(META)}, professors array<{_struct(PROFESSOR)}>"


def slug_of(path_column, suffix: str):
    return F.regexp_extract(path_column, rf"([^/]*){suffix}$", 1)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document: school (from the file name), metadata, professors."""
    return spark.read.schema(RAW).option("multiLine", True).json(path).withColumn("school", slug_of(F.input_file_name(), r"\.json"))


def entities(raw: DataFrame) -> DataFrame:
    """Professors with their place in the document; a missing department is Unknown, missing tags are none."""
    p = raw.select("school", F.posexplode("professors").alias("ordinal", "p"))
    return p.select(
        "school", "ordinal", F.col("p.id").alias("entity_id"), "p.legacy_id", F.concat_ws(" ", "p.first_name", "p.last_name").alias("name"), F.coalesce("p.department", F.lit("Unknown")).alias("department"),
        "p.avg_rating", "p.avg_difficulty", "p.num_ratings", "p.would_take_again_pct", F.coalesce("p.top_tags", F.array().cast("array<struct<tag:string,count:bigint>>")).alias("top_tags"),
    )


def reviews(raw: DataFrame) -> DataFrame:
    """Reviews with the places of their professor and of their own in the document."""
    p = raw.select("school", F.posexplode("professors").alias("entity_ordinal", "p"))
    r = p.select("school", "entity_ordinal", F.col("p.id").alias("entity_id"), F.posexplode("p.reviews").alias("review_ordinal", "r"))
    return r.select(
        "school", "entity_ordinal", "entity_id", "review_ordinal", F.col("r.id").alias("review_id"), "r.class_name", "r.date", "r.comment", F.col("r.clarity_rating").alias("clarity"),
        F.col("r.helpful_rating").alias("helpful"), F.col("r.difficulty_rating").alias("difficulty"), "r.would_take_again", "r.grade", "r.rating_tags", "r.is_online", "r.is_for_credit",
        "r.attendance_mandatory", F.coalesce("r.thumbs_up", F.lit(0)).alias("thumbs_up"), F.coalesce("r.thumbs_down", F.lit(0)).alias("thumbs_down"),
    )


#: The services' names of the columns of a review and of a professor.
REVIEW_NAMES = {
    "id": "id", "class": "class_name", "date": "date", "comment": "comment", "helpfulRating": "helpful_rating", "clarityRating": "clarity_rating", "difficultyRating": "difficulty_rating",
    "ratingTags": "rating_tags", "wouldTakeAgain": "would_take_again", "grade": "grade", "isForOnlineClass": "is_online", "isForCredit": "is_for_credit",
    "attendanceMandatory": "attendance_mandatory", "thumbsUpTotal": "thumbs_up", "thumbsDownTotal": "thumbs_down",
}
PROFESSOR_NAMES = {
    "id": "id", "legacyId": "legacy_id", "firstName": "first_name", "lastName": "last_name", "department": "department", "avgRating": "avg_rating", "avgDifficulty": "avg_difficulty",
    "numRatings": "num_ratings", "wouldTakeAgainPercent": "would_take_again_pct",
}


def _kinds(fields: str) -> dict[str, str]:
    return dict(f.split(" ", 1) for f in fields.split(", ") if " " in f)


NODE = ", ".join(f"{theirs} {_kinds(PROFESSOR)[ours]}" for theirs, ours in PROFESSOR_NAMES.items()) + ", teacherRatingTags array<struct<tagName:string,tagCount:bigint>>"
REVIEW_NODE = ", ".join(f"{theirs} {_kinds(REVIEW)[ours]}" for theirs, ours in REVIEW_NAMES.items())


def parsed(listing: DataFrame, schema: str = NODE) -> DataFrame:
    """A listing's rows (node as JSON, and others) with the node's fields as columns; a node that is no JSON has null fields."""
    return listing.withColumn("_node", F.from_json("node", schema)).select(*(c for c in listing.columns if c not in ("node", "id")), "_node.*")


def from_listing(nodes: DataFrame, *more: str) -> DataFrame:
    """A listing's camel-case nodes as professor rows; tags renamed, missing tags none; `more` names further columns to keep."""
    tags = F.transform(F.coalesce("teacherRatingTags", F.array().cast("array<struct<tagName:string,tagCount:bigint>>")), lambda t: F.struct(t["tagName"].alias("tag"), t["tagCount"].alias("count")))
    own = [F.coalesce(c, F.lit("Unknown")).alias(n) if n == "department" else F.col(c).alias(n) for c, n in PROFESSOR_NAMES.items()]
    return nodes.select(*more, *own, tags.alias("top_tags"))


def to_listing(professors: DataFrame) -> DataFrame:
    """Professor rows as camel-case nodes again, as a re-fetch takes them."""
    tags = F.transform("top_tags", lambda t: F.struct(t["tag"].alias("tagName"), t["count"].alias("tagCount")))
    return professors.select(*(F.col(n).alias(c) for c, n in PROFESSOR_NAMES.items()), tags.alias("teacherRatingTags"))


def review_rows(nodes: DataFrame, *more: str) -> DataFrame:
    """Camel-case review nodes as reviews of a raw document; `more` names further columns to keep."""
    return nodes.select(*more, *(F.col(c).alias(n) for c, n in REVIEW_NAMES.items()))


def with_reviews(professors: DataFrame, reviews: DataFrame) -> DataFrame:
    """Professors with their reviews (professor_id, place, review columns) nested in order; none is an empty list."""
    names = list(REVIEW_NAMES.values())
    kind = f"array<{_struct(REVIEW)}>"
    nested = reviews.groupBy("professor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", *names))), lambda r: F.struct(*(r[n].alias(n) for n in names))).cast(kind).alias("reviews"))
    joined = professors.join(nested, professors["id"] == nested["professor_id"], "left").drop("professor_id")
    return joined.withColumn("reviews", F.coalesce("reviews", F.array().cast(kind)))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """slug, name, professors, reviews of every *_analyzed.json, by file; only metadata is parsed.

    A readable document without metadata is left out; one that cannot be read is listed by its slug with zeros.
    """
    schema = f"metadata {_struct(META)}, _bad string"
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(f"{folder}/*_analyzed.json")
    slug = slug_of(F.input_file_name(), r"_analyzed\.json")
    rows = docs.select(slug.alias("slug"), "metadata", "_bad").where("metadata IS NOT NULL OR _bad IS NOT NULL")
    return rows.select("slug", F.coalesce("metadata.school_name", "slug").alias("name"), F.coalesce("metadata.total_professors", F.lit(0)).alias("professors"), F.coalesce("metadata.total_reviews", F.lit(0)).alias("reviews")).orderBy("slug")


def default_slug(schools: DataFrame, fallback: str = "umich") -> str:
    row = schools.orderBy("slug").limit(1).first()
    return row["slug"] if row else fallback


def write_analyzed(analyzed: DataFrame, path: str) -> None:
    """Partitioned by school, so that a school's queries read its files only."""
    analyzed.write.partitionBy("school").mode("overwrite").parquet(path)


class UnknownSchool(LookupError):
    """No analyzed document of the asked school."""


def read_analyzed(spark: SparkSession, path: str, slug: str) -> DataFrame:
    """A school's rows of an analyzed table; only its partition is read. Raises UnknownSchool if there is none."""
    rows = spark.read.parquet(path).where(F.col("school") == F.lit(slug))
    if rows.isEmpty():
        raise UnknownSchool(slug)
    return rows


def to_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; non-ASCII text is kept."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_raw(raw: DataFrame, path: str) -> None:
    """One JSON document per row of (school, metadata, professors), in a folder for each school."""
    raw.select("school", F.to_json(F.struct("metadata", "professors")).alias("value")).write.partitionBy("school").mode("overwrite").text(path)


class SchoolCache:
    """The last `most` schools that were asked for, persisted; the list of schools for `ttl` seconds unless it is empty."""

    def __init__(self, load: Callable[[str], DataFrame], listed: Callable[[], list], most: int = 10, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.load, self.listed, self.most, self.ttl, self.clock = load, listed, most, ttl, clock
        self.held: OrderedDict[str, DataFrame] = OrderedDict()
        self.schools: tuple[float, list] = (0.0, [])

    def get(self, slug: str) -> DataFrame:
        if slug in self.held:
            self.held.move_to_end(slug)
            return self.held[slug]
        df = self.load(slug).persist()
        if len(self.held) >= self.most:
            self.held.popitem(last=False)[1].unpersist()
        self.held[slug] = df
        return df

    def list(self) -> list:
        at, rows = self.schools
        if not rows or self.clock() - at >= self.ttl:
            self.schools = (self.clock(), self.listed())
        return self.schools[1]
