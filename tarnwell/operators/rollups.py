"""Aggregates over reviews and analyzed entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import GRADE_ORDER, NO_GRADE, share
from ..functions.scalars import exact_mean, mean_of_present, rnd, strip, truthy

HIGHLIGHTS = 5
TOP_GRADES = 5
GROUPS = ("A range", "B range", "C range", "D/F")
GPA = {"A range": 3.8, "B range": 3.0, "C range": 2.0, "D/F": 0.8}


def grade_distribution(reviews: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """keys, grade, n, rank: grades that tell an outcome, most frequent first, ties by first appearance."""
    told = reviews.where((F.col("grade") != "") & ~F.col("grade").isin(*NO_GRADE))
    counts = told.groupBy(*keys, "grade").agg(F.count(F.lit(1)).alias("n"), F.min("review_ordinal").alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first", "grade")
    return counts.select(*keys, "grade", "n", F.row_number().over(w).cast("long").alias("rank"))


def grade_group(grade: Column) -> Column:
    """A, B and C by first letter; every other outcome is D/F."""
    return F.when(grade.startswith("A"), GROUPS[0]).when(grade.startswith("B"), GROUPS[1]).when(grade.startswith("C"), GROUPS[2]).otherwise(GROUPS[3])


def grade_counts() -> list[Column]:
    """Aggregates: n_grades, and g0.. for each group, of grades that tell an outcome."""
    told = F.coalesce((F.col("grade") != "") & ~F.col("grade").isin(*NO_GRADE), F.lit(False))
    return [F.count_if(told).alias("n_grades"), *(F.count_if(told & (grade_group(F.col("grade")) == g)).alias(f"g{i}") for i, g in enumerate(GROUPS))]


def grade_shares() -> dict[str, Column]:
    """Percentages from grade_counts(); null where there are no grades."""
    n = F.nullif("n_grades", F.lit(0))
    return {c: share(F.col(f"g{i}"), n) for i, c in enumerate(("a_range", "b_range", "c_range", "d_f"))}


def grade_probabilities(reviews: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """keys, one percentage for each group (a_range, b_range, c_range, d_f), n_grades; entities without grades are absent."""
    return reviews.groupBy(*keys).agg(*grade_counts()).where("n_grades > 0").select(*keys, *(c.alias(n) for n, c in grade_shares().items()), "n_grades")


def class_breakdown(reviews: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """keys, class_name, num_reviews, avg_rating, first_ordinal: classes with two reviews or more.

    Ratings count if present and not 0; a review's rating is the mean of those it has.
    """
    rated = reviews.select(*keys, "review_ordinal", strip("class_name").alias("class_name"), mean_of_present(truthy("clarity"), truthy("helpful")).alias("rating"))
    return (
        rated.where("class_name <> ''")
        .groupBy(*keys, "class_name")
        .agg(F.count(F.lit(1)).alias("num_reviews"), rnd(F.sum("rating") / F.nullif(F.count("rating"), F.lit(0)), 1).alias("avg_rating"), F.min("review_ordinal").alias("first_ordinal"))
        .where("num_reviews >= 2")
    )


def class_grades(reviews: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """keys, class_name, grade, n, rank: the five most frequent grades of each class, of any kind but empty."""
    named = reviews.select(*keys, "review_ordinal", strip("class_name").alias("class_name"), "grade").where("class_name <> '' AND grade <> ''")
    counts = named.groupBy(*keys, "class_name", "grade").agg(F.count(F.lit(1)).alias("n"), F.min("review_ordinal").alias("first"))
    w = Window.partitionBy(*keys, "class_name").orderBy(F.desc("n"), "first", "grade")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= TOP_GRADES).select(*keys, "class_name", "grade", "n", "rank")


def _day(date: str) -> Column:
    return F.substring(F.coalesce(date, F.lit("")), 1, 10)


def highlight_ranks(reviews: DataFrame, as_of: str, keys: tuple[str, ...] = ("entity_id",), more: tuple[str, ...] = ()) -> DataFrame:
    """reviews(.., comment_length) -> keys, `more`, review_ordinal, score and rank of the five most useful ones of each key.

    comment_length is that of the stripped comment: texts stay out of the sort, and a task sends on five rows of a key.
    """
    age = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp(_day("date"), F.lit("yyyy-MM-dd")))) / 86400)
    recent = F.coalesce(F.greatest(F.lit(0.0), 3.0 - age / 365.0), F.lit(0.0))
    votes = F.coalesce("thumbs_up", F.lit(0)) - F.coalesce("thumbs_down", F.lit(0))
    score = votes + F.least(F.col("comment_length") / 200.0, F.lit(2.0)) + recent
    scored = reviews.where("comment_length >= 30").select(*keys, *more, "review_ordinal", score.alias("score"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "review_ordinal")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= HIGHLIGHTS)


def highlights(reviews: DataFrame, as_of: str, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """keys, rank and the five most useful comments: votes, length and recency against the moment `as_of`."""
    shown = F.struct(
        F.substring("comment", 1, 500).alias("comment"), F.coalesce("class_name", F.lit("")).alias("class_name"), F.coalesce("grade", F.lit("")).alias("grade"), _day("date").alias("date"), "clarity", "helpful", "difficulty",
    )
    stripped = reviews.withColumn("comment", strip("comment")).withColumn("comment_length", F.length("comment"))
    # the struct's fields are computed after the filter, and only the head of a text goes through the sort
    ranked = highlight_ranks(stripped.withColumn("shown", shown), as_of, keys, ("shown",))
    return ranked.select(*keys, "review_ordinal", "shown.*", "score", "rank")


def department_rows(entities: DataFrame) -> DataFrame:
    """department, professor_count, avg_rating; a null department is one of its own; a rating of 0 is none."""
    r = truthy("avg_rating")
    rows = entities.groupBy("department").agg(F.count(F.lit(1)).alias("professor_count"), rnd(exact_mean(r), 2).alias("avg_rating"), F.min("ordinal").alias("first_ordinal"))
    return rows.orderBy(F.desc("professor_count"), "first_ordinal").drop("first_ordinal")


def school_stats(entities: DataFrame) -> DataFrame:
    """One row for each school; distinct departments count null as one. total_reviews is the metadata's, where rows have it."""
    r, d = truthy("avg_rating"), truthy("avg_difficulty")
    return entities.groupBy("school").agg(
        F.count(F.lit(1)).alias("total_professors"),
        rnd(exact_mean(r), 2).alias("avg_rating"),
        rnd(exact_mean(d), 2).alias("avg_difficulty"),
        (F.countDistinct("department") + F.max(F.col("department").isNull().cast("int"))).cast("long").alias("departments"),
        *([F.coalesce(F.max("total_reviews"), F.lit(0)).cast("long").alias("total_reviews")] if "total_reviews" in entities.columns else []),
    )


def course_rows(classes: DataFrame, search: str | None = None, most: int = 100) -> DataFrame:
    """classes(name, class_name, num_reviews, ordinal) -> the courses of most reviews with their teachers, repeats kept."""
    named = classes.withColumn("course", F.upper(strip("class_name"))).where("course <> ''")
    if search:
        named = named.where(F.contains("course", F.lit(search.upper())))
    rows = named.groupBy("course").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("who"), F.sum("num_reviews").alias("total_reviews"), F.min("ordinal").alias("first"))
    return rows.orderBy(F.desc("total_reviews"), "first", "course").limit(most).select("course", F.transform("who", lambda x: x["name"]).alias("professors"), "total_reviews")


def grade_histogram(distribution: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """keys, grade, n, best_first: known grades from best to worst; the first of them is the one shown as typical."""
    place = F.array_position(F.array(*map(F.lit, GRADE_ORDER)), F.col("grade"))
    return distribution.where(place > 0).select(*keys, "grade", "n", F.row_number().over(Window.partitionBy(*keys).orderBy(place)).cast("long").alias("best_first"))


def unique_best(column: str, lowest: bool = False) -> Column:
    """Whether a row alone has the best value of the column, over all rows of a comparison of a few."""
    best = (F.min if lowest else F.max)(column).over(Window.partitionBy())
    return F.coalesce((F.col(column) == best) & (F.count(F.lit(1)).over(Window.partitionBy(column)) == 1), F.lit(False))


def sentiment_pivot(sentiment: DataFrame, categories: tuple[str, ...], ids: list[str]) -> DataFrame:
    """category by entity: percentage of positive reviews, 0 where there is none."""
    return sentiment.where(F.col("category").isin(*categories)).groupBy("category").pivot("entity_id", ids).agg(F.first("pct_positive")).fillna(0.0)
