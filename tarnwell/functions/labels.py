"""Plain-language labels derived from analyzed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import rnd, truthy, whole

#: Grades from best to worst, and those that say nothing about an outcome.
GRADE_ORDER = ("A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D", "D-", "F")
NO_GRADE = ("Not sure yet", "Rather not say", "Incomplete", "Drop/Withdrawal", "Audit/No Grade", "N/A")
#: Verdicts by the least chance of a good rating and the most difficulty, best first.
VERDICTS = (
    (0.85, 2.5, "Highly rated with a manageable workload"),
    (0.85, None, "Tough course, but students consistently rate the teaching highly"),
    (0.65, 3.0, "Well liked with reasonable difficulty"),
    (0.65, None, "Good teaching but expect to put in the work"),
    (0.45, None, "Mixed reviews. Student experiences vary quite a bit"),
    (0.30, None, "Below average reviews. Worth checking if this fits your learning style"),
    (None, None, "Most students had a tough time. Look into alternatives if you can"),
)
VERDICT_TRENDS = (("improving", ", but ratings have been improving recently"), ("declining", ", and ratings have been declining"))
#: Marks by the least chance of a good rating.
MARKS = ((0.85, "great"), (0.65, "good"), (0.45, "mixed"), (0.30, "caution"), (None, "poor"))
NO_TREND = "Not enough data"


def steps(value: Column, cuts: list[tuple[float, str]], rest: str, missing: str | None = None) -> Column:
    """The label of the first cut that the value reaches."""
    out = F.when(value.isNull(), F.lit(missing)) if missing is not None else F.when(F.lit(False), "")
    for at, name in cuts:
        out = out.when(value >= at, name)
    return out.otherwise(rest)


def confidence_level(n: Column, width: Column) -> Column:
    return (
        F.when((n >= 100) & (width < 0.15), "Very high").when((n >= 30) & (width < 0.30), "High").when(n >= 10, "Moderate").otherwise("Low")
    )


def confidence_detail(n: Column, width: Column) -> Column:
    level, count = confidence_level(n, width), n.cast("string")
    return (
        F.when(level == "Very high", F.concat(F.lit("Based on "), count, F.lit(" reviews, this is a reliable picture")))
        .when(level == "High", F.concat(F.lit("Based on "), count, F.lit(" reviews, fairly reliable")))
        .when(level == "Moderate", F.concat(F.lit("Based on "), count, F.lit(" reviews, decent sample but could shift with more data")))
        .otherwise(F.concat(F.lit("Only "), count, F.lit(" reviews so far, take these numbers with a grain of salt")))
    )


def trend_label(means: Column) -> Column:
    """From predicted means: the last quarter's mean against the first's. A difference of exactly 0.3 says nothing."""
    n = F.size(means)
    q = F.floor(n / 4).cast("int")
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.greatest(q, F.lit(1))
    diff, last = mean(F.slice(means, n - q + 1, q)) - mean(F.slice(means, 1, q)), F.element_at(means, -1)
    label = (
        F.when((F.abs(diff) < 0.3) & (last >= 4.0), "Consistently highly rated")
        .when((F.abs(diff) < 0.3) & (last >= 3.0), "Stable, middle-of-the-road ratings")
        .when(F.abs(diff) < 0.3, "Consistently low rated")
        .when(diff > 0.5, "Significantly improving over time")
        .when(diff > 0.3, "Trending upward recently")
        .when(diff < -0.5, "Declining over time")
        .when(diff < -0.3, "Trending downward recently")
        .otherwise(NO_TREND)
    )
    return F.when(F.coalesce(n, F.lit(0)) >= 4, label).otherwise(NO_TREND)


def verdict_base(good: Column, difficulty: Column) -> Column:
    d = F.coalesce(truthy(difficulty), F.lit(3.0))
    out = F.when(F.lit(False), "")
    for least, most, text in VERDICTS[:-1]:
        out = out.when((good >= least) & (d <= most if most is not None else F.lit(True)), text)
    return out.otherwise(VERDICTS[-1][2])


def verdict_emoji(good: Column) -> Column:
    return steps(good, list(MARKS[:-1]), MARKS[-1][1])


def verdict(good: Column, difficulty: Column, trend: Column) -> Column:
    t, suffix = F.lower(F.coalesce(trend, F.lit(""))), F.when(F.lit(False), "")
    for word, text in VERDICT_TRENDS:
        suffix = suffix.when(t.contains(word), text)
    return F.concat(verdict_base(good, difficulty), suffix.otherwise(""))


def short_verdict(v: Column) -> Column:
    return F.substring_index(F.substring_index(v, ".", 1), ",", 1)


def letter_grade(good: Column) -> Column:
    return steps(good, [(0.9, "A+"), (0.8, "A"), (0.7, "B+"), (0.6, "B"), (0.45, "C+"), (0.3, "C")], "D", "?")


def difficulty_label(d: Column, detail: bool = False) -> Column:
    cuts = [(4.5, "Very challenging"), (3.5, "Challenging"), (2.5, "Moderate")]
    return steps(d, [*cuts, (1.5, "Light")], "Very light") if detail else steps(d, cuts, "Light", "")


def sentiment_label(pct: Column) -> Column:
    return steps(pct, [(80, "Great"), (60, "Good"), (45, "Mixed"), (30, "Weak")], "Below average")


def _falling(trend: Column) -> Column:
    return F.lower(F.coalesce(trend, F.lit(""))).contains("declining")


def list_flags(rating: Column, difficulty: Column, wta: Column, trend: Column) -> Column:
    """Warnings of a list row, in order."""
    return F.array_compact(
        F.array(
            F.when((wta >= 0) & (wta < 35), "Few would retake"),
            F.when(rating < 2.5, "Below average ratings"),
            F.when(difficulty >= 4.5, "High difficulty"),
            F.when(_falling(trend), "Ratings trending down"),
        )
    )


def detail_flags(rating: Column, difficulty: Column, wta: Column, trend: Column, lectures_pct: Column) -> Column:
    """Warnings of a detail page; a rating of 0 is no rating."""
    return F.array_compact(
        F.array(
            F.when((wta >= 0) & (wta < 35), F.concat(whole(wta), F.lit("% of students would retake"))),
            F.when(truthy(rating) < 2.5, "Below average overall rating"),
            F.when(difficulty >= 4.5, "High difficulty level"),
            F.when(lectures_pct < 30, "Lecture quality rated below average"),
            F.when(_falling(trend), "Ratings have been trending down recently"),
        )
    )


def bottom_line(rating: Column, difficulty: Column, a_pct: Column, wta: Column) -> Column:
    """struct<quality, difficulty, grade, retake>; a missing value counts as the lowest, a missing difficulty as 3."""
    return F.struct(
        steps(rating, [(4, "High"), (3, "Average")], "Low").alias("quality"),
        difficulty_label(F.coalesce(truthy(difficulty), F.lit(3.0)), detail=True).alias("difficulty"),
        steps(F.coalesce(a_pct, F.lit(0.0)), [(70, "Likely an A"), (50, "Probably a B+"), (30, "Could go either way")], "Tough grading").alias("grade"),
        F.when(wta >= 70, "Most would").when(wta >= 50, "About half").when(wta >= 0, "Most wouldn't").otherwise("Unknown").alias("retake"),
    )


def trend_text(means: Column) -> Column:
    d = F.element_at(means, -1) - F.element_at(means, 1)
    return (
        F.when(d > 0.5, "Ratings have improved noticeably over time")
        .when(d > 0.2, "Ratings have been trending up slightly")
        .when(d < -0.5, "Ratings have shifted down over time")
        .when(d < -0.2, "Ratings have been trending down slightly")
        .otherwise("Ratings have been fairly stable")
    )


def fit_ring(score: Column) -> Column:
    return steps(score, [(75, "high"), (55, "medium")], "low")


def tag_opacity(count: Column, most: Column) -> Column:
    return F.greatest(F.lit(0.25), F.try_divide(count.cast("double"), most.cast("double")))


def preview(comment: Column, n: int = 280) -> Column:
    return F.when(F.length(comment) > n, F.concat(F.substring(comment, 1, n), F.lit("..."))).otherwise(comment)


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(name, " "), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")


def semester_label(difficulty: Column) -> Column:
    return F.when(difficulty.isNull(), "Not enough data").when(difficulty >= 4.0, "Very heavy semester").when(difficulty >= 3.5, "Challenging semester").when(difficulty >= 2.5, "Manageable semester").otherwise("Light semester")


def share(part: Column, total: Column, digits: int = 1) -> Column:
    """part of total in percent; 0 where total is 0."""
    return F.when(total > 0, rnd(part / total * 100, digits)).otherwise(0.0)
