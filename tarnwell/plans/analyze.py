"""The batch analysis: entities and reviews in, one analyzed row for each entity out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import posterior, rollups, topics, trend


def analyze(entities: DataFrame, reviews: DataFrame, as_of: str, model: DataFrame | None = None, sequential: bool = True) -> DataFrame:
    """entities(school, ordinal, entity_id, name, department, averages, top_tags), reviews -> the analyzed document's rows.

    `model` is a trained topic model; without one it is trained on the reviews, serially or in one batch pass.
    `as_of` is the moment that recency counts from.
    """
    keys = ("school", "entity_id")
    if model is None:
        model = topics.train(reviews) if sequential else topics.train_batch(reviews)
    counts = posterior.rating_counts(reviews, keys)
    told = entities.join(counts, list(keys), "left").fillna(0, [c for c in counts.columns if c.startswith(("n_", "s_"))])
    told = told.select(*entities.columns, "n_overall", posterior.rating_posteriors().alias("rating_posteriors"), F.struct(*(posterior.sub_rating(s).alias(s) for s in posterior.SUB)).alias("sub_rating_posteriors"), posterior.retake_posterior().alias("would_take_again_posterior"))

    at = (*keys, "entity_ordinal", "review_ordinal")
    scored = topics.scores(reviews.where("comment <> ''"), model, at, partition=("school",))
    rated = topics.members(scored).join(reviews.select(*at, "clarity", "helpful"), list(at))
    sentiment = topics.category_sentiment(rated, keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("mean_sentiment", "n_reviews", "pct_positive")))).alias("category_sentiment"))
    trends = trend.rating_trend(reviews, keys)
    trends = trends.select(*keys, F.struct(*(c for c in trends.columns if c not in keys)).alias("gp_trend"))
    grades = rollups.grade_distribution(reviews, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "grade", "n"))), lambda x: F.struct(x["grade"].alias("grade"), x["n"].alias("n"))).alias("grade_distribution"))
    shares = rollups.grade_probabilities(reviews, keys).select(*keys, F.struct("a_range", "b_range", "c_range", "d_f").alias("grade_probabilities"))
    by_class = rollups.class_grades(reviews, keys).groupBy(*keys, "class_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "grade", "n"))), lambda x: F.struct(x["grade"].alias("grade"), x["n"].alias("n"))).alias("grades"))
    classes = rollups.class_breakdown(reviews, keys).join(by_class, [*keys, "class_name"], "left")
    classes = classes.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("num_reviews")).alias("o"), "first_ordinal", "class_name", "num_reviews", "avg_rating", "grades"))), lambda x: F.struct(*(x[c].alias(c) for c in ("class_name", "num_reviews", "avg_rating", "grades")))).alias("class_breakdown"))
    shown = ("comment", "class_name", "grade", "date", "clarity", "helpful", "difficulty", "score")
    best = rollups.highlights(reviews, as_of, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *shown))), lambda x: F.struct(*(x[c].alias(c) for c in shown))).alias("review_highlights"))
    for part in (sentiment, trends, grades, shares, classes, best):
        told = told.join(part, list(keys), "left")
    none = F.struct(*(F.lit(0.0).alias(c) for c in ("a_range", "b_range", "c_range", "d_f")))
    good = F.col("rating_posteriors.good")
    width = good["ci_upper"] - good["ci_lower"]
    undated = F.from_json(F.lit('{"insufficient_data": true, "n_reviews_with_dates": 0, "capped": false}'), told.schema["gp_trend"].dataType)
    return (
        told.withColumn("gp_trend", F.coalesce("gp_trend", undated))
        .withColumn("grade_probabilities", F.coalesce("grade_probabilities", none))
        .withColumn("trend_summary", labels.trend_label(F.col("gp_trend.pred_mean")))
        .withColumn("confidence_level", labels.confidence_level(F.col("n_overall"), width))
        .withColumn("confidence_detail", labels.confidence_detail(F.col("n_overall"), width))
        .withColumn("verdict", labels.verdict(good["mean"], F.col("avg_difficulty"), F.col("trend_summary")))
        .withColumn("verdict_emoji", labels.verdict_emoji(good["mean"]))
    )
