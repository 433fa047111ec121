"""The query layer over analyzed rows: listing, comparison, preference fit, course candidates and semester plans.

Rows need: entity_id, legacy_id, name, department, ordinal, avg_rating, avg_difficulty, num_ratings,
would_take_again_pct, good_prob, and what the query at hand names. Ties keep document order (ordinal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.scalars import contains, exact_mean, items, rnd, strip, truthy, whole
from ..operators.rollups import GPA, GROUPS

SORTS = ("rating", "difficulty", "num_ratings", "name")
GRADE_COLUMNS = dict(zip(GROUPS, ("a_range", "b_range", "c_range", "d_f"), strict=True))
ASPECTS = ("grading", "lectures", "approachability", "workload")


def _bounded(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}")
    return value


def filtered(rows: DataFrame, department: str | None = None, search: str | None = None) -> DataFrame:
    if department:
        rows = rows.where(contains("department", department))
    if search:
        rows = rows.where(contains("name", search) | contains("department", search))
    return rows


def list_professors(rows: DataFrame, department: str | None = None, search: str | None = None, sort_by: str = "rating", limit: int = 200) -> DataFrame:
    _bounded("limit", limit, 1, 500)
    key = {"difficulty": "avg_difficulty", "num_ratings": "num_ratings"}.get(sort_by, "avg_rating")
    order = F.coalesce("name", F.lit("")).asc() if sort_by == "name" else F.coalesce(key, F.lit(0)).desc()
    return filtered(rows, department, search).orderBy(order, "ordinal").limit(limit)


def professor(rows: DataFrame, entity_id) -> DataFrame:
    return rows.where(F.col("entity_id") == F.lit(entity_id)).orderBy("ordinal").limit(1)


def compare(rows: DataFrame, ids: str) -> DataFrame:
    """The named entities in table order; unknown ids are ignored."""
    return rows.where(F.col("entity_id").cast("string").isin(items(ids, blanks=True))).orderBy("ordinal")


def fit_score(difficulty: int = 3, grading: int = 3, lectures: int = 3, approachability: int = 3, workload: int = 3) -> Column:
    """0 to 100: how well a row matches the preferences. Needs pct_<aspect> columns, null where unknown."""
    prefs = {"grading": grading, "lectures": lectures, "approachability": approachability, "workload": workload}
    for name, p in {"difficulty": difficulty, **prefs}.items():
        _bounded(name, p, 1, 5)
    d = F.coalesce(truthy("avg_difficulty"), F.lit(3.0))
    hard = F.greatest(F.lit(0.0), (5.0 - d) / 4.0) if difficulty <= 2 else F.greatest(F.lit(0.0), d / 5.0) if difficulty >= 4 else F.greatest(F.lit(0.0), 1.0 - F.abs(d - 3.0) / 2.0)
    score, weight = hard * 100 * 2.0, F.lit(2.0)
    for name in ASPECTS:
        pct, w = F.col(f"pct_{name}"), 2.5 if prefs[name] >= 4 else 0.5 if prefs[name] <= 2 else 1.5
        value = F.when(pct < 50, pct * 0.6).otherwise(pct) if prefs[name] >= 4 else pct
        score = score + F.coalesce(value * w, F.lit(0.0))
        weight = weight + F.when(pct.isNotNull(), w).otherwise(0.0)
    score = score + F.coalesce(truthy("avg_rating"), F.lit(3.0)) / 5.0 * 100 * 1.5
    weight = weight + 1.5
    asked = F.col("would_take_again_pct") >= 0
    score = score + F.when(asked, F.col("would_take_again_pct") * 1.0).otherwise(0.0)
    weight = weight + F.when(asked, 1.0).otherwise(0.0)
    fit = rnd(score / weight, 1)
    n = F.col("num_ratings")
    return F.when(n < 10, rnd(fit * 0.85, 1)).when(n < 20, rnd(fit * 0.92, 1)).otherwise(fit)


def fit_reasons(difficulty: int = 3, grading: int = 3, lectures: int = 3, approachability: int = 3) -> Column:
    d = F.coalesce(truthy("avg_difficulty"), F.lit(3.0))
    lec, appr, a = truthy("pct_lectures"), truthy("pct_approachability"), F.col("a_range")
    text = lambda before, x, after: F.concat(F.lit(before), whole(x), F.lit(after))
    reasons = [
        F.when(F.lit(difficulty <= 2) & (d <= 2.5), "Low difficulty matches your preference").when(F.lit(difficulty >= 4) & (d >= 3.5), "Challenging, as you prefer"),
        F.when(F.lit(lectures >= 4) & (lec >= 70), text("Strong lectures (", lec, "% positive)")).when(F.lit(lectures >= 4) & (lec < 40), text("Lectures may not match your expectations (", lec, "% positive)")),
        F.when(F.lit(approachability >= 4) & (appr >= 70), text("Highly approachable (", appr, "% positive)")),
        F.when(F.lit(grading <= 2) & (a >= 70), text("", a, "% chance of A")),
    ]
    return F.slice(F.array_compact(F.array(*reasons)), 1, 3)


def fit(rows: DataFrame, department: str | None = None, limit: int = 20, **prefs: int) -> DataFrame:
    _bounded("limit", limit, 1, 100)
    scored = filtered(rows, department).where(F.col("num_ratings") >= 3).withColumn("fit_score", fit_score(**prefs))
    scored = scored.withColumn("fit_reasons", fit_reasons(**{k: v for k, v in prefs.items() if k != "workload"}))
    return scored.orderBy(F.desc("fit_score"), "ordinal").limit(limit)


def course_codes(courses: str) -> list[str]:
    return [c.upper() for c in items(courses)]


def candidates(classes: DataFrame, courses: str) -> DataFrame:
    """classes(class_name, ...) of every asked course: the code within the class's name or the name within the code.

    Codes are parameters of a call; they form the small side of a nested-loop join. A course without candidates is absent.
    """
    codes = list(dict.fromkeys(course_codes(courses)))
    asked = classes.sparkSession.createDataFrame([(c, i) for i, c in enumerate(codes)], "course string, course_place int")
    named = classes.withColumn("cname", F.upper(strip("class_name"))).where("cname <> ''")
    return named.join(F.broadcast(asked), F.contains("cname", F.col("course")) | F.contains(F.col("course"), F.col("cname")))


def schedule(classes: DataFrame, courses: str) -> DataFrame:
    """Candidates of each course, best first by the class's own rating, else the entity's; `place` counts from 1."""
    key = F.coalesce(truthy("course_rating"), truthy("avg_rating"), F.lit(0.0))
    w = Window.partitionBy("course").orderBy(F.desc(key), "ordinal", "class_place")
    return candidates(classes, courses).withColumn("place", F.row_number().over(w).cast("long"))


def optimizer_score(preference: str = "balanced") -> Column:
    """Composite score to 4 digits; any unknown preference is balanced."""
    r = F.coalesce(truthy("avg_rating"), F.lit(3.0)) / 5.0
    h = F.coalesce(truthy("avg_difficulty"), F.lit(3.0)) / 5.0
    g = F.coalesce("good_prob", F.lit(0.5))
    a = F.coalesce(truthy("a_range") / 100.0, F.lit(0.3))
    w = F.when(F.col("would_take_again_pct") > 0, F.col("would_take_again_pct") / 100.0).otherwise(0.5)
    if preference == "easy":
        score = r * 0.2 + (1.0 - h) * 0.35 + a * 0.25 + w * 0.2
    elif preference == "challenge":
        score = r * 0.4 + g * 0.3 + w * 0.2 + h * 0.1
    else:
        score = r * 0.3 + g * 0.25 + a * 0.2 + w * 0.15 + (1.0 - h) * 0.1
    n = F.col("course_reviews")
    return rnd(F.when(n < 5, score * 0.8).when(n < 10, score * 0.9).otherwise(score), 4)


def ranked(classes: DataFrame, courses: str, preference: str = "balanced") -> DataFrame:
    w = Window.partitionBy("course").orderBy(F.desc("optimizer_score"), "ordinal", "class_place")
    return candidates(classes, courses).withColumn("optimizer_score", optimizer_score(preference)).withColumn("place", F.row_number().over(w).cast("long"))


def recommended(ranks: DataFrame) -> DataFrame:
    return ranks.where(F.col("place") == 1)


def alternatives(ranks: DataFrame) -> DataFrame:
    """The next three of each course."""
    return ranks.where(F.col("place").between(2, 4))


def warnings(ranks: DataFrame, courses: str) -> DataFrame:
    """course, warning: what speaks against each recommendation, and courses without data, in the order asked."""
    codes = list(dict.fromkeys(course_codes(courses)))
    asked = ranks.sparkSession.createDataFrame([(c, i) for i, c in enumerate(codes)], "course string, at int")
    best = recommended(ranks)
    d, wta = F.coalesce(truthy("avg_difficulty"), F.lit(3.0)), F.col("would_take_again_pct")
    say = F.array_compact(
        F.array(
            F.when(F.col("entity_id").isNull(), F.lit("No professor data found")),
            F.when(F.col("entity_id").isNotNull() & (d >= 4.0), F.concat("name", F.lit(" is rated very difficult ("), F.format_string("%.1f", d), F.lit("/5)"))),
            F.when((wta >= 0) & (wta < 40), F.concat(F.lit("Only "), whole(wta), F.lit("% would retake with "), "name")),
            F.when(F.coalesce("good_prob", F.lit(0.5)) < 0.4, F.concat("name", F.lit(" has low confidence rating - consider alternatives"))),
        )
    )
    rows = asked.join(best.drop("course_place"), "course", "left").select("course", "at", F.posexplode(say).alias("k", "text"))
    return rows.orderBy("at", "k").select("course", F.concat_ws(": ", "course", "text").alias("warning"))


def semester(ranks: DataFrame, courses: str) -> DataFrame:
    """One row: averages over the recommended entities, an estimated GPA, a label, and counts of courses."""
    d, r = F.coalesce(truthy("avg_difficulty"), F.lit(3.0)), F.coalesce(truthy("avg_rating"), F.lit(3.0))
    parts = [F.coalesce(F.col(c), F.lit(0.0)) / 100.0 * GPA[g] for g, c in GRADE_COLUMNS.items()]
    some = F.greatest(*(F.coalesce(F.col(c), F.lit(0.0)) for c in GRADE_COLUMNS.values())) > 0
    sums = recommended(ranks).agg(exact_mean(d).alias("d"), exact_mean(r).alias("r"), F.avg(F.when(some, sum(parts[1:], parts[0]))).alias("g"), F.count(F.lit(1)).alias("courses_with_data"))
    return sums.select(
        rnd(F.col("d"), 2).alias("avg_difficulty"), rnd(F.col("r"), 2).alias("avg_quality"), rnd(F.col("g"), 2).alias("estimated_gpa"), labels.semester_label(F.col("d")).alias("difficulty_label"),
        F.lit(len(course_codes(courses))).cast("long").alias("num_courses"), "courses_with_data",
    )


def service_info(schools: DataFrame) -> DataFrame:
    """One row: how many schools are served."""
    return schools.agg(F.count(F.lit(1)).alias("schools"))


def school_list(schools: DataFrame, search: str | None = None, pinned: str | None = None) -> DataFrame:
    """schools(slug, name, ...): those whose name holds the text, the pinned one first, then by name."""
    rows = schools.where(contains("name", search)) if search else schools
    return rows.orderBy(F.coalesce(F.col("slug") == F.lit(pinned), F.lit(False)).desc(), "name", "slug")


def suggestions(rows: DataFrame, text: str, chosen: tuple[str, ...] = (), most: int = 8) -> DataFrame:
    """Entities to offer for a typed text of two characters or more, without those already chosen."""
    if len(text.strip()) < 2:
        return rows.limit(0)
    return filtered(rows, search=text.strip()).where(~F.col("entity_id").cast("string").isin(*chosen) if chosen else F.lit(True)).orderBy("ordinal").limit(most)


def comparable(ids: list[str]) -> list[str]:
    """Two to four different ids."""
    ids = list(dict.fromkeys(ids))
    if not 2 <= len(ids) <= 4:
        raise ValueError("choose two to four to compare")
    return ids


def course_specific() -> Column:
    """What a schedule row tells of the class itself."""
    return F.struct(F.col("class_name").alias("class_name"), F.col("course_rating").alias("avg_rating"), F.col("course_reviews").alias("num_reviews"))


def top_tags(tags: Column, most: int = 5) -> Column:
    """The first tags with their opacity against the most frequent one."""
    most_frequent = F.array_max(F.transform(tags, lambda t: t["count"]))
    return F.transform(F.slice(tags, 1, most), lambda t: F.struct(t["tag"].alias("tag"), t["count"].alias("count"), labels.tag_opacity(t["count"], most_frequent).alias("opacity")))
