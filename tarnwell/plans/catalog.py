"""Registered queries: the library's operators applied to the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.scalars import slug, strip, whole
from ..operators import merging, posterior, rollups, topics, trend
from ..sources import schools as school_files
from ..sources import testdata
from ..streaming import admission
from . import endpoints, oracle

FLAGSHIP = "list_professors"
COURSES = ",".join([*oracle.ASKED[:1], " ", *oracle.ASKED[1:]])
AS_OF = "2002-01-01 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL = oracle.SQL


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _rows(spark: SparkSession, sf_dir: str, grades: bool = False) -> DataFrame:
    """Entities with the columns of a list row; `grades` adds the shares of grades from the same pass over the reviews."""
    counts = posterior.rating_counts(testdata.reviews(spark, sf_dir), more=rollups.grade_counts() if grades else ())
    e = testdata.entities(spark, sf_dir, counts)
    good = posterior.posterior(F.col("n_good"), F.col("n_overall"), posterior.THRESHOLDS["good"])
    e = e.withColumn("good", good).withColumn("n_overall", F.coalesce("n_overall", F.lit(0)))
    return e.select("school", "ordinal", "entity_id", "legacy_id", "name", "department", "avg_rating", "avg_difficulty", "num_ratings", "would_take_again_pct", F.col("good.mean").alias("good_prob"), "good.ci_lower", "good.ci_upper", "n_overall", *((c.alias(n) for n, c in rollups.grade_shares().items()) if grades else ()))


def _shown(*more: Column | str) -> list[Column | str]:
    width = F.col("ci_upper") - F.col("ci_lower")
    return [
        "entity_id", "legacy_id", "name", "department", "avg_rating", "avg_difficulty", "num_ratings", "would_take_again_pct", "good_prob", "ci_lower", "ci_upper",
        labels.confidence_level(F.col("n_overall"), width).alias("confidence_level"), labels.verdict_base(F.col("good_prob"), F.col("avg_difficulty")).alias("verdict"),
        labels.verdict_emoji(F.col("good_prob")).alias("verdict_emoji"), labels.letter_grade(F.col("good_prob")).alias("letter"), *more,
    ]


@query
def list_professors(spark, sf_dir):
    return endpoints.list_professors(_rows(spark, sf_dir)).select(*_shown())


@query
def list_professors_search(spark, sf_dir):
    return endpoints.list_professors(_rows(spark, sf_dir), department="nation_1", search="ION_1", sort_by="name").select(*_shown())


@query
def professor(spark, sf_dir):
    return endpoints.professor(_rows(spark, sf_dir), 7).select(*_shown())


@query
def compare(spark, sf_dir):
    best = rollups.unique_best("avg_rating").alias("best_rating"), rollups.unique_best("avg_difficulty", lowest=True).alias("easiest")
    return endpoints.compare(_rows(spark, sf_dir), "9, 3,5, ,unknown").select(*_shown(*best))


@query
def departments(spark, sf_dir):
    return rollups.department_rows(_rows(spark, sf_dir))


@query
def school_stats(spark, sf_dir):
    n = testdata.read(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("total_reviews"))  # one row, as metadata has it
    return rollups.school_stats(_rows(spark, sf_dir).crossJoin(F.broadcast(n)))


@query
def school_totals(spark, sf_dir):
    e = _rows(spark, sf_dir).select("entity_id", F.array_repeat(F.lit(1), F.col("num_ratings").cast("int")).alias("reviews"))
    return merging.totals(e)


@query
def professor_tags(spark, sf_dir):
    """The first five tags of every row with their opacity."""
    shown = testdata.tags(spark, sf_dir).select("entity_id", F.posexplode(endpoints.top_tags(F.col("top_tags"))).alias("place", "t"))
    return shown.select("entity_id", "place", "t.tag", "t.count", "t.opacity")


@query
def list_rows(spark, sf_dir):
    """Whole list rows, the first five tags with them."""
    tags = testdata.tags(spark, sf_dir).select("entity_id", F.array_join(F.transform(endpoints.top_tags(F.col("top_tags")), lambda t: F.concat_ws(":", t["tag"], t["count"].cast("string"))), "|").alias("top_tags"))
    return endpoints.list_professors(_rows(spark, sf_dir).join(tags, "entity_id", "left")).select(*_shown("top_tags"))


def _counts(spark, sf_dir):
    return posterior.rating_counts(testdata.reviews(spark, sf_dir))


@query
def rating_posteriors(spark, sf_dir):
    return posterior.long_posteriors(_counts(spark, sf_dir))


@query
def sub_rating_posteriors(spark, sf_dir):
    each = F.array(*(F.struct(F.lit(k).alias("dimension"), posterior.sub_rating(k).alias("p")) for k in posterior.SUB))
    return _counts(spark, sf_dir).select("entity_id", F.explode(each).alias("x")).where("x.p IS NOT NULL").select("entity_id", "x.dimension", "x.p.*")


@query
def retake_posterior(spark, sf_dir):
    return _counts(spark, sf_dir).select("entity_id", posterior.retake_posterior().alias("p")).where("p IS NOT NULL").select("entity_id", "p.*")


@query
def grade_distribution(spark, sf_dir):
    return rollups.grade_distribution(testdata.reviews(spark, sf_dir))


@query
def grade_histogram(spark, sf_dir):
    return rollups.grade_histogram(rollups.grade_distribution(testdata.reviews(spark, sf_dir)))


@query
def grade_probabilities(spark, sf_dir):
    return rollups.grade_probabilities(testdata.reviews(spark, sf_dir))


@query
def class_breakdown(spark, sf_dir):
    return rollups.class_breakdown(testdata.reviews(spark, sf_dir, classes=True))


@query
def class_grades(spark, sf_dir):
    return rollups.class_grades(testdata.reviews(spark, sf_dir, classes=True))


def _classes(spark, sf_dir):
    """Class rows with the columns of their entity and its grade shares."""
    reviews = testdata.reviews(spark, sf_dir, classes=True)
    classes = rollups.class_breakdown(reviews).select("entity_id", "class_name", "first_ordinal", F.col("num_reviews").alias("course_reviews"), F.col("avg_rating").alias("course_rating"))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("course_reviews"), "first_ordinal", "class_name"))
    return classes.withColumn("class_place", place).join(_rows(spark, sf_dir, grades=True), "entity_id")


def _courses(spark, sf_dir, search=None):
    classes = _classes(spark, sf_dir).withColumn("num_reviews", F.col("course_reviews"))
    return rollups.course_rows(classes, search).select("course", F.size("professors").cast("long").alias("n_professors"), F.md5(F.array_join("professors", "|").cast("binary")).alias("professors_md5"), "total_reviews")


@query
def courses(spark, sf_dir):
    """The professors of a course, repeats kept, as the hash of their names in order: the lists are long."""
    return _courses(spark, sf_dir)


@query
def courses_search(spark, sf_dir):
    return _courses(spark, sf_dir, "and#2")


@query
def first_courses(spark, sf_dir):
    """The first eight courses that a detail page shows."""
    rows = _classes(spark, sf_dir).select("entity_id", "class_name", F.col("class_place").cast("long").alias("class_place"), "course_reviews")
    return merging.first_by_place(rows, "entity_id", "class_place", 8)


@query
def schedule(spark, sf_dir):
    return endpoints.schedule(_classes(spark, sf_dir), COURSES).select("course", "entity_id", "name", "class_name", "course_rating", "course_reviews", "avg_rating", "good_prob", "place")


@query
def schedule_rows(spark, sf_dir):
    rows = endpoints.schedule(_classes(spark, sf_dir), COURSES).withColumn("course_specific", endpoints.course_specific())
    return rows.select("course", "place", *_shown(), F.col("course_specific.class_name").alias("specific_class"), F.col("course_specific.avg_rating").alias("specific_rating"), F.col("course_specific.num_reviews").alias("specific_reviews"))


@query
def optimizer_rows(spark, sf_dir):
    rows = endpoints.ranked(_classes(spark, sf_dir), COURSES).where(F.col("place") <= 4)
    return rows.select("course", "place", *_shown(), "class_name", "course_rating", "course_reviews", "optimizer_score", "a_range", "b_range", "c_range", "d_f")


def _optimize(preference: str):
    def ranks(spark, sf_dir):
        return endpoints.ranked(_classes(spark, sf_dir), COURSES, preference)

    def optimize(spark, sf_dir):
        return ranks(spark, sf_dir).where(F.col("place") <= 4).select("course", "entity_id", "name", "class_name", "course_rating", "course_reviews", "optimizer_score", "place")

    def semester(spark, sf_dir):
        return endpoints.semester(ranks(spark, sf_dir), COURSES)

    return optimize, semester


for _preference in ("balanced", "easy", "challenge"):
    QUERIES[f"optimize_{_preference}"], QUERIES[f"semester_{_preference}"] = _optimize(_preference)


@query
def semester_warnings(spark, sf_dir):
    return endpoints.warnings(endpoints.ranked(_classes(spark, sf_dir), COURSES), COURSES)


def _topics(spark, sf_dir):
    docs = testdata.documents_as_reviews(spark, sf_dir)
    return docs.select("doc_id", F.explode(topics.seed_scores("comment")).alias("x")).select("doc_id", "x.*")


@query
def topic_scores(spark, sf_dir):
    return _topics(spark, sf_dir)


def _as_one_school(spark, sf_dir):
    return testdata.documents_as_reviews(spark, sf_dir).withColumn("school", F.lit("testdata"))


@query
def topic_scores_trained(spark, sf_dir):
    docs = _as_one_school(spark, sf_dir)
    return topics.scores(docs, topics.train_batch(docs), ("school", "doc_id"), partition=("school",))


@query
def topic_model_serial(spark, sf_dir):
    """The serial self-training over every document in the order of ids: each confident one changes what the next one meets."""
    docs = _as_one_school(spark, sf_dir).withColumns({"entity_ordinal": F.lit(0), "review_ordinal": F.col("doc_id")})
    return topics.train(docs)


@query
def top_categories(spark, sf_dir):
    return topics.ranked_members(_topics(spark, sf_dir), ("doc_id",)).select("doc_id", "category", "probability", "place")


def _with_doc(spark, sf_dir, reviews: DataFrame) -> DataFrame:
    n = testdata.read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_docs"))
    return reviews.crossJoin(F.broadcast(n)).withColumn("doc_id", F.col("doc_key") % F.col("n_docs"))  # one row


def _sentiment(spark, sf_dir):
    reviews = _with_doc(spark, sf_dir, testdata.reviews(spark, sf_dir).select("entity_id", "clarity", "helpful", "doc_key"))
    # an array of one, exploded: each text is scored once
    scored = testdata.documents_as_reviews(spark, sf_dir).select("doc_id", F.explode(F.array(topics.seed_scores("comment"))).alias("x"))
    return topics.sentiment_by_flags(reviews.join(scored.select("doc_id", *(c.alias(n) for n, c in topics.member_columns(F.col("x")).items())), "doc_id"))


@query
def category_sentiment(spark, sf_dir):
    return _sentiment(spark, sf_dir)


def _fit(spark, sf_dir):
    wide = _sentiment(spark, sf_dir).groupBy("entity_id").agg(*(F.max(F.when(F.col("category") == c, F.col("pct_positive"))).alias(f"pct_{c}") for c in topics.CATEGORIES))
    rows = _rows(spark, sf_dir, grades=True).join(wide, "entity_id", "left")
    return endpoints.fit(rows, limit=100, **oracle.FIT_PREFS)


@query
def fit(spark, sf_dir):
    return _fit(spark, sf_dir).select("entity_id", "name", "department", "avg_rating", "avg_difficulty", "num_ratings", "would_take_again_pct", "fit_score")


@query
def fit_rows(spark, sf_dir):
    return _fit(spark, sf_dir).select(*_shown(), "fit_score", F.array_join("fit_reasons", "|").alias("fit_reasons"), "a_range", labels.fit_ring(F.col("fit_score")).alias("ring"))


@query
def highlights(spark, sf_dir):
    lengths = testdata.documents_as_reviews(spark, sf_dir).select("doc_id", F.length(strip("comment")).alias("comment_length"))  # a number for each text, found once
    reviews = _with_doc(spark, sf_dir, testdata.reviews(spark, sf_dir)).join(lengths, "doc_id")
    return rollups.highlight_ranks(reviews, AS_OF, more=("doc_key",)).select("entity_id", "doc_key", "score", "rank")


@query
def label_columns(spark, sf_dir):
    rows = _rows(spark, sf_dir, grades=True)
    line = labels.bottom_line(F.col("avg_rating"), F.col("avg_difficulty"), F.col("a_range"), F.col("would_take_again_pct"))
    flags = labels.list_flags(F.col("avg_rating"), F.col("avg_difficulty"), F.col("would_take_again_pct"), F.lit(None).cast("string"))
    return rows.select("entity_id", labels.letter_grade(F.col("good_prob")).alias("letter"), labels.difficulty_label(F.col("avg_difficulty")).alias("difficulty_label"), F.when(F.size(flags) > 0, F.array_join(flags, "|")).alias("flags"), line["grade"].alias("grade_line"))


QUERIES["labels"] = QUERIES.pop("label_columns")


@query
def detail_labels(spark, sf_dir):
    """What a detail page says of every row: warnings, bottom line, short verdict, initials, and numbers as text."""
    wide = _sentiment(spark, sf_dir).where(F.col("category") == "lectures").select("entity_id", F.col("pct_positive").alias("pct_lectures"))
    rows = _rows(spark, sf_dir, grades=True).join(wide, "entity_id", "left")
    none = F.lit(None).cast("string")
    flags = labels.detail_flags(F.col("avg_rating"), F.col("avg_difficulty"), F.col("would_take_again_pct"), none, F.col("pct_lectures"))
    line = labels.bottom_line(F.col("avg_rating"), F.col("avg_difficulty"), F.col("a_range"), F.col("would_take_again_pct"))
    width = F.col("ci_upper") - F.col("ci_lower")
    return rows.select(
        "entity_id", F.array_join(flags, "|").alias("flags"), line["quality"].alias("quality"), line["difficulty"].alias("difficulty"), line["retake"].alias("retake"),
        labels.short_verdict(labels.verdict_base(F.col("good_prob"), F.col("avg_difficulty"))).alias("short_verdict"), labels.initials(F.col("name")).alias("initials"),
        whole(F.col("would_take_again_pct")).alias("retake_text"), labels.confidence_detail(F.col("n_overall"), width).alias("confidence_detail"),
    )


@query
def comment_previews(spark, sf_dir):
    return testdata.documents_as_reviews(spark, sf_dir).select("doc_id", labels.preview(F.col("comment")).alias("preview"))


@query
def rating_trend(spark, sf_dir):
    t = trend.rating_trend(testdata.reviews(spark, sf_dir), lists=False)
    return t.select("entity_id", "insufficient_data", "n_data_points", "date_range", labels.trend_label(F.col("pred_mean")).alias("trend_summary"), labels.trend_text(F.col("pred_mean")).alias("trend_text"), F.element_at("pred_mean", -1).alias("last_mean"), F.element_at("pred_std", -1).alias("last_std"))


@query
def admitted_requests(spark, sf_dir):
    told = admission.admitted(testdata.read(spark, sf_dir, "events"), limit=3, window=86400.0)
    return told.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def _suppliers(spark, sf_dir):
    return testdata.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("num_ratings"))


def _buyers(spark, sf_dir):
    """The customers that ordered anything, with the number of their orders."""
    return testdata.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("num_ratings"))


@query
def unknown_entities(spark, sf_dir):
    """Customers found by their orders that are not known as suppliers."""
    found = _buyers(spark, sf_dir).join(testdata.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id")
    return merging.unknown(found, _suppliers(spark, sf_dir)).select("id", "name")


@query
def upserted_entities(spark, sf_dir):
    """Suppliers are known; customers are fetched, with reviews if they ordered anything; some ids are new."""
    known = _suppliers(spark, sf_dir).select("id", "name", F.col("id").alias("ordinal"), F.array(F.lit(1)).alias("reviews"))
    customers = testdata.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    fetched = customers.join(_buyers(spark, sf_dir), "id", "left").select("id", "name", F.when(F.col("num_ratings") > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("reviews"))
    return merging.upserted(known, fetched).select("id", "name")


@query
def appended_entities(spark, sf_dir):
    customers = testdata.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return merging.appended(_suppliers(spark, sf_dir), customers).withColumn("num_ratings", F.coalesce("num_ratings", F.lit(-1)))


@query
def fetched_next(spark, sf_dir):
    """Suppliers that have line items are known, all are found: no new ones, so those without reviews are fetched again."""
    n = testdata.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    s = _suppliers(spark, sf_dir).join(n, "id", "left")
    few = s.select("id", "num_ratings", F.when(F.col("n") >= 595, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("reviews"))
    return merging.to_fetch(s, few)


@query
def selected_schools(spark, sf_dir):
    catalog = testdata.read(spark, sf_dir, "nation").select(slug("n_name").alias("slug"), F.col("n_name").alias("name"))
    return merging.looked_up(catalog, ["nation_3", "nowhere", "nation_1", "nation_3"]).select("place", "slug", "name", "known")


@query
def run_counters(spark, sf_dir):
    return merging.run_counters(catalog_status(spark, sf_dir))


@query
def missing_schools(spark, sf_dir):
    n = testdata.read(spark, sf_dir, "nation")
    files = n.where("n_nationkey % 3 > 0").select(slug("n_name").alias("slug"))
    return merging.selected(n.select(slug("n_name").alias("slug"), F.col("n_name").alias("name")), files, "missing")


@query
def ingest_limits(spark, sf_dir):
    """The first 20 reviews of every entity: what one page of an ingest takes."""
    rows = testdata.reviews(spark, sf_dir).select("entity_id", "review_ordinal")
    return merging.first_by_place(rows, "entity_id", "review_ordinal", 20)


@query
def listing_rows(spark, sf_dir):
    """Suppliers as a service's camel-case nodes in JSON, parsed and renamed, and renamed back."""
    e = _rows(spark, sf_dir).join(testdata.tags(spark, sf_dir), "entity_id", "left")
    tags = F.transform("top_tags", lambda t: F.struct(t["tag"].alias("tagName"), t["count"].alias("tagCount")))
    node = F.struct(
        F.col("entity_id").cast("string").alias("id"), F.col("legacy_id").alias("legacyId"), F.lit("Sup").alias("firstName"), F.col("name").alias("lastName"), F.when(F.col("entity_id") % 5 > 0, F.col("department")).alias("department"),
        F.col("avg_rating").alias("avgRating"), F.col("avg_difficulty").alias("avgDifficulty"), F.col("num_ratings").alias("numRatings"), F.col("would_take_again_pct").alias("wouldTakeAgainPercent"), tags.alias("teacherRatingTags"),
    )
    rows = school_files.from_listing(school_files.parsed(e.select(F.to_json(node).alias("node"))))
    again = school_files.to_listing(rows)
    return again.select(
        F.col("id").cast("long").alias("entity_id"), "lastName", "department", "avgRating", "numRatings", "wouldTakeAgainPercent", F.size("teacherRatingTags").cast("long").alias("n_tags"), F.get("teacherRatingTags", F.lit(0))["tagName"].alias("first_tag")
    )


@query
def catalog_status(spark, sf_dir):
    n = testdata.read(spark, sf_dir, "nation")
    files = n.where("n_nationkey % 3 > 0").select(slug("n_name").alias("slug"), (F.col("n_nationkey") % 3 == 1).alias("readable"), F.col("n_nationkey").cast("long").alias("professors"), (F.col("n_nationkey") * 10).cast("long").alias("reviews"))
    return merging.catalog_status(n.select(slug("n_name").alias("slug"), F.col("n_name").alias("name")), files)


def _schools(spark, sf_dir):
    """Regions as schools: their suppliers and line items are entities and reviews."""
    rows = _rows(spark, sf_dir).join(testdata.read(spark, sf_dir, "nation").select(F.col("n_name").alias("department"), F.col("n_regionkey").alias("r_regionkey")), "department")
    sums = rows.groupBy("r_regionkey").agg(F.count(F.lit(1)).alias("professors"), F.sum("num_ratings").alias("reviews"))
    return testdata.read(spark, sf_dir, "region").join(sums, "r_regionkey", "left").select(slug("r_name").alias("slug"), F.col("r_name").alias("name"), F.coalesce("professors", F.lit(0)).alias("professors"), F.coalesce("reviews", F.lit(0)).alias("reviews"))


@query
def schools(spark, sf_dir):
    return endpoints.school_list(_schools(spark, sf_dir), pinned="asia")


@query
def schools_search(spark, sf_dir):
    """The schools whose name holds a typed text, the pinned one first."""
    return endpoints.school_list(_schools(spark, sf_dir), search="A", pinned="middleeast")


@query
def service_info(spark, sf_dir):
    return endpoints.service_info(_schools(spark, sf_dir))


@query
def sentiment_pivot(spark, sf_dir):
    ids = endpoints.comparable(["3", "5", "9"])
    pivot = rollups.sentiment_pivot(_sentiment(spark, sf_dir), topics.CATEGORIES, [int(i) for i in ids])
    return pivot.select("category", *(F.col(i).alias(f"entity_{i}") for i in ids))


@query
def suggested_professors(spark, sf_dir):
    return endpoints.suggestions(_rows(spark, sf_dir), "lier#", chosen=("1", "2")).select("entity_id", "name")


@query
def semester_alternatives(spark, sf_dir):
    return endpoints.alternatives(endpoints.ranked(_classes(spark, sf_dir), COURSES)).select("course", "entity_id", "optimizer_score", "place")


@query
def sentiment_order(spark, sf_dir):
    """An entity's categories as a page shows them: those of most reviews first."""
    seeds = F.array_position(F.array(*map(F.lit, topics.CATEGORIES)), F.col("category"))
    w = Window.partitionBy("entity_id").orderBy(F.desc("n_reviews"), seeds)
    return _sentiment(spark, sf_dir).select("entity_id", "category", F.row_number().over(w).cast("long").alias("place"))


@query
def sentiment_labels(spark, sf_dir):
    return _sentiment(spark, sf_dir).select("entity_id", "category", labels.sentiment_label(F.col("pct_positive")).alias("label"))
