"""SQL that says what the registered queries say, for engines other than Spark."""

from __future__ import annotations

import math

from ..functions.labels import GRADE_ORDER, NO_GRADE
from ..functions.scalars import STOPWORDS
from ..operators.posterior import SUB, THRESHOLDS
from ..operators.rollups import GPA
from ..operators.topics import CATEGORIES, SPARE_VOCABULARY, seed_counts
from ..sources.testdata import GRADES


def text(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def rnd(x: str, digits: int) -> str:
    return f"(floor(({x}) * {num(10.0**digits)} + {num(0.5)}) / {num(10.0**digits)})"


def post(s: str, n: str) -> dict[str, str]:
    a, b = f"({s} + {num(2.0)})", f"({n} - {s} + {num(2.0)})"
    mean, var = f"({a} / ({a} + {b}))", f"({a} * {b} / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + {num(1.0)})))"
    some = lambda x, none: f"CASE WHEN {n} > 0 THEN {x} ELSE {none} END"
    return {
        "alpha": a,
        "beta": b,
        "mean": rnd(mean, 4),
        "variance": some(rnd(var, 6), var),
        "std": some(rnd(f"sqrt({var})", 4), "NULL"),
        "ci_lower": some(rnd(f"greatest({num(0.0)}, {mean} - sqrt({var}) * {num(1.96)})", 4), num(0.0)),
        "ci_upper": some(rnd(f"least({num(1.0)}, {mean} + sqrt({var}) * {num(1.96)})", 4), num(1.0)),
    }


REV = f"""rev AS (
  SELECT l_suppkey AS entity_id, p_brand AS class_name, CAST(1 + CAST(floor((l_quantity - 1) / 10) AS INT) AS DOUBLE) AS clarity,
         CAST(1 + l_partkey % 5 AS DOUBLE) AS helpful, CAST(1 + least(4, CAST(floor(l_discount * 100 + 0.5) AS INT) // 2) AS DOUBLE) AS difficulty,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'O' THEN 1 WHEN l_linestatus = 'F' THEN 0 END AS would_take_again,
         ([{text(GRADES)}])[CAST(1 + l_orderkey % 9 AS INT)] AS grade, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS date,
         l_linenumber AS thumbs_up, CAST(floor(l_tax * 100 + 0.5) AS INT) AS thumbs_down, l_orderkey AS doc_key,
         l_orderkey * 8 + l_linenumber AS review_ordinal
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

CNT = f"""cnt AS (
  SELECT entity_id, count(*) AS n_reviews, count((clarity + helpful) / 2) AS n_overall, sum((clarity + helpful) / 2) AS sum_overall,
         {", ".join(f"count(*) FILTER ((clarity + helpful) / 2 >= {t}) AS n_{k}" for k, t in THRESHOLDS.items())},
         count(clarity) AS n_clarity, count(*) FILTER (clarity >= {SUB["clarity"]}) AS s_clarity, sum(clarity) AS sum_clarity,
         count(helpful) AS n_helpfulness, count(*) FILTER (helpful >= {SUB["helpfulness"]}) AS s_helpfulness, sum(helpful) AS sum_helpfulness,
         count(difficulty) AS n_difficulty, count(*) FILTER (5 - difficulty >= {SUB["difficulty"]}) AS s_difficulty, sum(difficulty) AS sum_difficulty,
         count(*) FILTER (would_take_again = 1) AS n_yes, count(*) FILTER (would_take_again = 0) AS n_no
  FROM rev GROUP BY entity_id)"""

_GOOD = post("coalesce(n_good, 0)", "coalesce(n_overall, 0)")
_WIDTH = f"({_GOOD['ci_upper']} - {_GOOD['ci_lower']})"
ENT = f"""ent AS (
  SELECT s_suppkey AS entity_id, s_suppkey AS ordinal, s_suppkey AS legacy_id, s_name AS name, n_name AS department,
         {rnd("sum_overall / nullif(n_overall, 0)", 2)} AS avg_rating, {rnd("sum_difficulty / nullif(n_difficulty, 0)", 2)} AS avg_difficulty,
         coalesce(n_reviews, 0) AS num_ratings, CASE WHEN n_yes + n_no > 0 THEN {rnd(f"CAST(n_yes AS DOUBLE) / (n_yes + n_no) * {num(100.0)}", 1)} ELSE {num(-1.0)} END AS would_take_again_pct,
         {_GOOD["mean"]} AS good_prob, {_GOOD["ci_lower"]} AS ci_lower, {_GOOD["ci_upper"]} AS ci_upper, coalesce(n_overall, 0) AS n_overall, {_WIDTH} AS width
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN cnt ON s_suppkey = entity_id)"""

_NO = text(NO_GRADE)
PROB = f"""prob AS (
  SELECT entity_id, {", ".join(f"CASE WHEN n > 0 THEN {rnd(f'CAST({g} AS DOUBLE) / n * {num(100.0)}', 1)} ELSE {num(0.0)} END AS {g}" for g in ("a_range", "b_range", "c_range", "d_f"))}, n AS n_grades
  FROM (SELECT entity_id, count(*) AS n, count(*) FILTER (grade LIKE 'A%') AS a_range, count(*) FILTER (grade LIKE 'B%') AS b_range, count(*) FILTER (grade LIKE 'C%') AS c_range,
               count(*) FILTER (NOT (grade LIKE 'A%' OR grade LIKE 'B%' OR grade LIKE 'C%')) AS d_f
        FROM rev WHERE grade <> '' AND grade NOT IN ({_NO}) GROUP BY entity_id))"""

CLS = f"""cls AS (
  SELECT entity_id, trim(class_name) AS class_name, count(*) AS num_reviews, {rnd("sum((clarity + helpful) / 2) / count(*)", 1)} AS avg_rating, min(review_ordinal) AS first_ordinal
  FROM rev WHERE trim(class_name) <> '' GROUP BY entity_id, trim(class_name) HAVING count(*) >= 2)"""


def _logs() -> str:
    counts = seed_counts()
    vocabulary = len(set().union(*counts.values())) + SPARE_VOCABULARY
    out = []
    for c in CATEGORIES:
        scale = float(sum(counts[c].values()) + vocabulary)
        known = sorted(set(counts[c].values()))
        hit = {k: f"len(list_filter(w, lambda x: x IN ({text(t for t, n in counts[c].items() if n == k)})))" for k in known}
        parts = " + ".join(f"{hit[k]} * {num(math.log((k + 1.0) / scale))}" for k in known)
        out.append(f"{num(math.log(1 / len(CATEGORIES)))} + (len(w) - ({' + '.join(hit.values())})) * {num(math.log(1.0 / scale))} + ({parts}) AS l_{c}")
    return ",\n         ".join(out)


_EXPS = " + ".join(f"e_{c}" for c in CATEGORIES)
TOPIC = f"""wrd AS (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 1 AND x NOT IN ({text(STOPWORDS)})) AS w FROM documents),
lgs AS (SELECT doc_id, {_logs()} FROM wrd),
exs AS (SELECT doc_id, {", ".join(f"exp(l_{c} - greatest({', '.join(f'l_{x}' for x in CATEGORIES)})) AS e_{c}" for c in CATEGORIES)} FROM lgs),
topic AS ({" UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, {rnd(f'e_{c} / ({_EXPS})', 4)} AS probability FROM exs" for c in CATEGORIES)})"""

SENT = f"""sent AS (
  SELECT entity_id, category, {rnd("sum((clarity + helpful) / 2) / count(*)", 2)} AS mean_sentiment, count(*) AS n_reviews,
         {rnd(f"CAST(count(*) FILTER ((clarity + helpful) / 2 >= 3.5) AS DOUBLE) / count(*) * {num(100.0)}", 1)} AS pct_positive
  FROM rev JOIN topic ON doc_id = doc_key % (SELECT count(*) FROM documents) WHERE probability >= 0.25 GROUP BY entity_id, category)"""

LEVEL = "CASE WHEN n_overall >= 100 AND width < 0.15 THEN 'Very high' WHEN n_overall >= 30 AND width < 0.30 THEN 'High' WHEN n_overall >= 10 THEN 'Moderate' ELSE 'Low' END"
VERDICT = (
    "CASE WHEN good_prob >= 0.85 AND coalesce(nullif(avg_difficulty, 0), 3) <= 2.5 THEN 'Highly rated with a manageable workload' WHEN good_prob >= 0.85 THEN 'Tough course, but students consistently rate the teaching highly' "
    "WHEN good_prob >= 0.65 AND coalesce(nullif(avg_difficulty, 0), 3) <= 3.0 THEN 'Well liked with reasonable difficulty' WHEN good_prob >= 0.65 THEN 'Good teaching but expect to put in the work' "
    "WHEN good_prob >= 0.45 THEN 'Mixed reviews. Student experiences vary quite a bit' WHEN good_prob >= 0.30 THEN 'Below average reviews. Worth checking if this fits your learning style' ELSE 'Most students had a tough time. Look into alternatives if you can' END"
)
EMOJI = "CASE WHEN good_prob >= 0.85 THEN 'great' WHEN good_prob >= 0.65 THEN 'good' WHEN good_prob >= 0.45 THEN 'mixed' WHEN good_prob >= 0.30 THEN 'caution' ELSE 'poor' END"
LETTER = "CASE WHEN good_prob >= 0.9 THEN 'A+' WHEN good_prob >= 0.8 THEN 'A' WHEN good_prob >= 0.7 THEN 'B+' WHEN good_prob >= 0.6 THEN 'B' WHEN good_prob >= 0.45 THEN 'C+' WHEN good_prob >= 0.3 THEN 'C' ELSE 'D' END"
ROW = f"entity_id, legacy_id, name, department, avg_rating, avg_difficulty, num_ratings, would_take_again_pct, good_prob, ci_lower, ci_upper, {LEVEL} AS confidence_level, {VERDICT} AS verdict, {EMOJI} AS verdict_emoji, {LETTER} AS letter"
_R, _H = "coalesce(nullif(avg_rating, 0), 3)", "coalesce(nullif(avg_difficulty, 0), 3)"
ASKED = ("brand#1", "Brand#23", "Brand#23", "nothing")


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def fit(difficulty: int, **prefs: int) -> str:
    hard = f"greatest(0, (5 - {_H}) / 4)" if difficulty <= 2 else f"greatest(0, {_H} / 5)" if difficulty >= 4 else f"greatest(0, 1 - abs({_H} - 3) / 2)"
    score, weight = f"{hard} * 100 * 2", "2"
    for k, p in prefs.items():
        w = 2.5 if p >= 4 else 0.5 if p <= 2 else 1.5
        value = f"CASE WHEN pct_{k} < 50 THEN pct_{k} * {num(0.6)} ELSE pct_{k} END" if p >= 4 else f"pct_{k}"
        score += f" + coalesce(({value}) * {num(w)}, 0)"
        weight += f" + CASE WHEN pct_{k} IS NOT NULL THEN {num(w)} ELSE 0 END"
    score += f" + {_R} / 5 * 100 * {num(1.5)} + CASE WHEN would_take_again_pct >= 0 THEN would_take_again_pct ELSE 0 END"
    weight += f" + {num(1.5)} + CASE WHEN would_take_again_pct >= 0 THEN 1 ELSE 0 END"
    one = rnd(f"({score}) / ({weight})", 1)
    return f"CASE WHEN num_ratings < 10 THEN {rnd(f'{one} * {num(0.85)}', 1)} WHEN num_ratings < 20 THEN {rnd(f'{one} * {num(0.92)}', 1)} ELSE {one} END"


def optimizer(preference: str) -> str:
    r, h, g, a = f"{_R} / 5", f"{_H} / 5", "coalesce(good_prob, 0.5)", f"coalesce(nullif(a_range, 0) / 100, {num(0.3)})"
    w = f"CASE WHEN would_take_again_pct > 0 THEN would_take_again_pct / 100 ELSE {num(0.5)} END"
    parts = {"easy": ((r, 0.2), (f"(1 - {h})", 0.35), (a, 0.25), (w, 0.2)), "challenge": ((r, 0.4), (g, 0.3), (w, 0.2), (h, 0.1))}.get(preference, ((r, 0.3), (g, 0.25), (a, 0.2), (w, 0.15), (f"(1 - {h})", 0.1)))
    score = " + ".join(f"({x}) * {num(k)}" for x, k in parts)
    return rnd(f"({score}) * CASE WHEN course_reviews < 5 THEN {num(0.8)} WHEN course_reviews < 10 THEN {num(0.9)} ELSE 1 END", 4)


_CODES = list(dict.fromkeys(c.upper() for c in ASKED))
CAND = f"""cand AS (
  SELECT course, ent.*, cls.class_name, cls.avg_rating AS course_rating, cls.num_reviews AS course_reviews, a_range, b_range, c_range, d_f,
         row_number() OVER (PARTITION BY cls.entity_id, course ORDER BY cls.num_reviews DESC, cls.first_ordinal, cls.class_name) AS class_place
  FROM cls JOIN ent USING (entity_id) LEFT JOIN prob USING (entity_id)
  JOIN (SELECT unnest([{text(_CODES)}]) AS course) ON contains(upper(cls.class_name), course) OR contains(course, upper(cls.class_name)))"""


def ranks(preference: str) -> str:
    return f"rk AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY optimizer_score DESC, ordinal, class_place) AS place FROM (SELECT *, {optimizer(preference)} AS optimizer_score FROM cand))"


_BASE = (REV, CNT, ENT)
_FULL = (REV, CNT, ENT, PROB, CLS, CAND)
FIT_PREFS = {"difficulty": 2, "grading": 2, "lectures": 5, "approachability": 4, "workload": 3}
SQL: dict[str, str] = {
    "list_professors": with_(*_BASE) + f"SELECT {ROW} FROM ent ORDER BY coalesce(avg_rating, 0) DESC, ordinal LIMIT 200",
    "list_professors_search": with_(*_BASE) + f"SELECT {ROW} FROM ent WHERE contains(lower(coalesce(department, '')), 'nation_1') AND (contains(lower(name), 'ion_1') OR contains(lower(coalesce(department, '')), 'ion_1')) ORDER BY name, ordinal LIMIT 200",
    "professor": with_(*_BASE) + f"SELECT {ROW} FROM ent WHERE entity_id = 7",
    "compare": with_(*_BASE) + f"SELECT {ROW}, avg_rating = max(avg_rating) OVER () AND count(*) OVER (PARTITION BY avg_rating) = 1 AS best_rating, avg_difficulty = min(avg_difficulty) OVER () AND count(*) OVER (PARTITION BY avg_difficulty) = 1 AS easiest FROM ent WHERE entity_id IN (3, 5, 9)",
    "departments": with_(*_BASE) + f"SELECT department, count(*) AS professor_count, {rnd('CAST(sum(CAST(nullif(avg_rating, 0) AS DECIMAL(20, 6))) AS DOUBLE) / nullif(count(nullif(avg_rating, 0)), 0)', 2)} AS avg_rating FROM ent GROUP BY department",
    "school_stats": with_(*_BASE) + f"SELECT 'testdata' AS school, count(*) AS total_professors, {rnd('CAST(sum(CAST(nullif(avg_rating, 0) AS DECIMAL(20, 6))) AS DOUBLE) / nullif(count(nullif(avg_rating, 0)), 0)', 2)} AS avg_rating, {rnd('CAST(sum(CAST(nullif(avg_difficulty, 0) AS DECIMAL(20, 6))) AS DOUBLE) / nullif(count(nullif(avg_difficulty, 0)), 0)', 2)} AS avg_difficulty, count(DISTINCT department) + CAST(max(CAST(department IS NULL AS INT)) AS BIGINT) AS departments, (SELECT count(*) FROM lineitem) AS total_reviews FROM ent",
    "rating_posteriors": with_(REV, CNT) + " UNION ALL ".join(f"SELECT entity_id, '{k}' AS level, {', '.join(f'{x} AS {c}' for c, x in post(f'n_{k}', 'n_overall').items())}, n_overall AS n_ratings, n_{k} AS n_above_threshold, {num(t)} AS threshold FROM cnt" for k, t in THRESHOLDS.items()),
    "sub_rating_posteriors": with_(REV, CNT) + " UNION ALL ".join(f"SELECT entity_id, '{k}' AS dimension, {', '.join(f'{x} AS {c}' for c, x in post(f's_{k}', f'n_{k}').items())}, n_{k} AS n_ratings, s_{k} AS n_above_threshold, {num(t)} AS threshold, {rnd(f'sum_{k} / n_{k}', 2)} AS raw_mean FROM cnt WHERE n_{k} > 0" for k, t in SUB.items()),
    "retake_posterior": with_(REV, CNT) + f"SELECT entity_id, {', '.join(f'{x} AS {c}' for c, x in post('n_yes', '(n_yes + n_no)').items())}, n_yes + n_no AS n_ratings, n_yes AS n_above_threshold, {num(3.0)} AS threshold FROM cnt WHERE n_yes + n_no > 0",
    "grade_distribution": with_(REV) + f"SELECT entity_id, grade, n, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, first, grade) AS rank FROM (SELECT entity_id, grade, count(*) AS n, min(review_ordinal) AS first FROM rev WHERE grade <> '' AND grade NOT IN ({_NO}) GROUP BY entity_id, grade)",
    "grade_histogram": with_(REV) + f"SELECT entity_id, grade, n, row_number() OVER (PARTITION BY entity_id ORDER BY list_position([{text(GRADE_ORDER)}], grade)) AS best_first FROM (SELECT entity_id, grade, count(*) AS n FROM rev WHERE grade NOT IN ({_NO}) GROUP BY entity_id, grade) WHERE list_contains([{text(GRADE_ORDER)}], grade)",
    "grade_probabilities": with_(REV, PROB) + "SELECT * FROM prob",
    "class_breakdown": with_(REV, CLS) + "SELECT * FROM cls",
    "class_grades": with_(REV) + "SELECT * FROM (SELECT entity_id, class_name, grade, n, row_number() OVER (PARTITION BY entity_id, class_name ORDER BY n DESC, first, grade) AS rank FROM (SELECT entity_id, class_name, grade, count(*) AS n, min(review_ordinal) AS first FROM rev GROUP BY entity_id, class_name, grade)) WHERE rank <= 5",
    "courses": with_(*_BASE, CLS) + "SELECT upper(class_name) AS course, CAST(count(*) AS BIGINT) AS n_professors, md5(string_agg(name, '|' ORDER BY ordinal, name)) AS professors_md5, CAST(sum(num_reviews) AS BIGINT) AS total_reviews FROM cls JOIN ent USING (entity_id) GROUP BY upper(class_name) ORDER BY total_reviews DESC, min(ordinal), course LIMIT 100",
    "topic_scores": with_(TOPIC) + "SELECT doc_id, category, probability FROM topic",
    "category_sentiment": with_(REV, TOPIC, SENT) + "SELECT * FROM sent",
    "fit": with_(*_BASE, TOPIC, SENT)
    + f"SELECT entity_id, name, department, avg_rating, avg_difficulty, num_ratings, would_take_again_pct, {fit(**FIT_PREFS)} AS fit_score FROM ent LEFT JOIN (SELECT entity_id, {', '.join(f'''max(pct_positive) FILTER (category = '{c}') AS pct_{c}''' for c in CATEGORIES)} FROM sent GROUP BY entity_id) USING (entity_id) WHERE num_ratings >= 3 ORDER BY fit_score DESC, ordinal LIMIT 100",
    "schedule": with_(*_FULL) + "SELECT course, entity_id, name, class_name, course_rating, course_reviews, avg_rating, good_prob, row_number() OVER (PARTITION BY course ORDER BY coalesce(nullif(course_rating, 0), nullif(avg_rating, 0), 0) DESC, ordinal, class_place) AS place FROM cand",
    "highlights": with_(REV)
    + f"SELECT * FROM (SELECT entity_id, doc_key, score, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, review_ordinal) AS rank FROM (SELECT entity_id, doc_key, review_ordinal, thumbs_up - thumbs_down + least(length(trim(text, ' \t\n\r')) / {num(200.0)}, {num(2.0)}) + greatest({num(0.0)}, {num(3.0)} - datediff('day', CAST(substr(date, 1, 10) AS DATE), DATE '2002-01-01') / {num(365.0)}) AS score FROM rev JOIN documents ON doc_id = doc_key % (SELECT count(*) FROM documents) WHERE length(trim(text, ' \t\n\r')) >= 30)) WHERE rank <= 5",
    "labels": with_(*_BASE, PROB) + f"SELECT entity_id, {LETTER} AS letter, CASE WHEN avg_difficulty >= 4.5 THEN 'Very challenging' WHEN avg_difficulty >= 3.5 THEN 'Challenging' WHEN avg_difficulty >= 2.5 THEN 'Moderate' WHEN avg_difficulty IS NULL THEN '' ELSE 'Light' END AS difficulty_label, list_aggregate(list_filter([CASE WHEN would_take_again_pct >= 0 AND would_take_again_pct < 35 THEN 'Few would retake' END, CASE WHEN avg_rating < 2.5 THEN 'Below average ratings' END, CASE WHEN avg_difficulty >= 4.5 THEN 'High difficulty' END], lambda x: x IS NOT NULL), 'string_agg', '|') AS flags, CASE WHEN a_range >= 70 THEN 'Likely an A' WHEN a_range >= 50 THEN 'Probably a B+' WHEN a_range >= 30 THEN 'Could go either way' ELSE 'Tough grading' END AS grade_line FROM ent LEFT JOIN prob USING (entity_id)",
    "unknown_entities": "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "upserted_entities": "SELECT coalesce(c.c_custkey, s_suppkey) AS id, coalesce(c_name, s_name) AS name FROM supplier FULL OUTER JOIN (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) c ON c.c_custkey = s_suppkey",
    "catalog_status": "SELECT lower(replace(replace(n_name, ' ', ''), '-', ''))[1:12] AS slug, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'Not scraped' WHEN n_nationkey % 3 = 1 THEN 'Ready' ELSE 'Error' END AS status, CASE WHEN n_nationkey % 3 = 1 THEN CAST(n_nationkey AS BIGINT) END AS professors, CASE WHEN n_nationkey % 3 = 1 THEN CAST(n_nationkey * 10 AS BIGINT) END AS reviews FROM nation",
}
_SCHOOLS = with_(*_BASE) + "SELECT lower(replace(replace(r_name, ' ', ''), '-', ''))[1:12] AS slug, r_name AS name, count(entity_id) AS professors, CAST(coalesce(sum(num_ratings), 0) AS BIGINT) AS reviews FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN ent ON department = n_name GROUP BY r_name"
SQL |= {
    "schools": _SCHOOLS,
    "service_info": "SELECT count(*) AS schools FROM region",
    "sentiment_pivot": with_(REV, TOPIC, SENT) + f"SELECT category, {', '.join(f'coalesce(max(pct_positive) FILTER (entity_id = {i}), 0) AS entity_{i}' for i in (3, 5, 9))} FROM sent GROUP BY category HAVING count(*) FILTER (entity_id IN (3, 5, 9)) >= 0",
    "suggested_professors": "SELECT s_suppkey AS entity_id, s_name AS name FROM supplier WHERE contains(lower(s_name), 'lier#') AND s_suppkey NOT IN (1, 2) ORDER BY s_suppkey LIMIT 8",
    "semester_alternatives": with_(*_FULL, ranks("balanced")) + "SELECT course, entity_id, optimizer_score, place FROM rk WHERE place BETWEEN 2 AND 4",
    "sentiment_labels": with_(REV, TOPIC, SENT) + "SELECT entity_id, category, CASE WHEN pct_positive >= 80 THEN 'Great' WHEN pct_positive >= 60 THEN 'Good' WHEN pct_positive >= 45 THEN 'Mixed' WHEN pct_positive >= 30 THEN 'Weak' ELSE 'Below average' END AS label FROM sent",
}
for _p in ("balanced", "easy", "challenge"):
    SQL[f"optimize_{_p}"] = with_(*_FULL, ranks(_p)) + "SELECT course, entity_id, name, class_name, course_rating, course_reviews, optimizer_score, place FROM rk WHERE place <= 4"
    _gpa = " + ".join(f"coalesce({c}, 0) / {num(100.0)} * {num(v)}" for c, v in zip(("a_range", "b_range", "c_range", "d_f"), GPA.values(), strict=True))
    SQL[f"semester_{_p}"] = (
        with_(*_FULL, ranks(_p))
        + f"SELECT {rnd('d', 2)} AS avg_difficulty, {rnd('r', 2)} AS avg_quality, {rnd('g', 2)} AS estimated_gpa, CASE WHEN d IS NULL THEN 'Not enough data' WHEN d >= 4 THEN 'Very heavy semester' WHEN d >= 3.5 THEN 'Challenging semester' WHEN d >= 2.5 THEN 'Manageable semester' ELSE 'Light semester' END AS difficulty_label, CAST({len(ASKED)} AS BIGINT) AS num_courses, courses_with_data FROM (SELECT CAST(sum(CAST({_H} AS DECIMAL(20, 6))) AS DOUBLE) / count(*) AS d, CAST(sum(CAST({_R} AS DECIMAL(20, 6))) AS DOUBLE) / count(*) AS r, avg(CASE WHEN greatest(coalesce(a_range, 0), coalesce(b_range, 0), coalesce(c_range, 0), coalesce(d_f, 0)) > 0 THEN {_gpa} END) AS g, count(*) AS courses_with_data FROM rk WHERE place = 1)"
    )


def _whole(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def _joined(*parts: str) -> str:
    return f"coalesce(array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)[1:3], '|'), '')"


_WIDE = f"wide AS (SELECT entity_id, {', '.join(f"max(pct_positive) FILTER (category = '{c}') AS pct_{c}" for c in CATEGORIES)} FROM sent GROUP BY entity_id)"
_ORDER = f"list_position([{text(CATEGORIES)}], category)"
_REASONS = _joined(
    f"CASE WHEN {_H} <= 2.5 THEN 'Low difficulty matches your preference' END",
    f"CASE WHEN nullif(pct_lectures, 0) >= 70 THEN 'Strong lectures (' || {_whole('pct_lectures')} || '% positive)' WHEN nullif(pct_lectures, 0) < 40 THEN 'Lectures may not match your expectations (' || {_whole('pct_lectures')} || '% positive)' END",
    f"CASE WHEN nullif(pct_approachability, 0) >= 70 THEN 'Highly approachable (' || {_whole('pct_approachability')} || '% positive)' END",
    f"CASE WHEN a_range >= 70 THEN {_whole('a_range')} || '% chance of A' END",
)
_FLAGS = [
    f"CASE WHEN would_take_again_pct >= 0 AND would_take_again_pct < 35 THEN {_whole('would_take_again_pct')} || '% of students would retake' END",
    "CASE WHEN nullif(avg_rating, 0) < 2.5 THEN 'Below average overall rating' END",
    "CASE WHEN avg_difficulty >= 4.5 THEN 'High difficulty level' END",
    "CASE WHEN pct_lectures < 30 THEN 'Lecture quality rated below average' END",
]
_TAGS = "tags AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY count DESC, tag) - 1 AS place, max(count) OVER (PARTITION BY entity_id) AS most FROM (SELECT l_suppkey AS entity_id, concat_ws(' ', l_returnflag, l_linestatus) AS tag, count(*) AS count FROM lineitem GROUP BY ALL))"
_DETAIL = "CASE {0} WHEN 'Very high' THEN 'Based on ' || n_overall || ' reviews, this is a reliable picture' WHEN 'High' THEN 'Based on ' || n_overall || ' reviews, fairly reliable' WHEN 'Moderate' THEN 'Based on ' || n_overall || ' reviews, decent sample but could shift with more data' ELSE 'Only ' || n_overall || ' reviews so far, take these numbers with a grain of salt' END"
_PLACE = "row_number() OVER (PARTITION BY course ORDER BY coalesce(nullif(course_rating, 0), nullif(avg_rating, 0), 0) DESC, ordinal, class_place) AS place"
_SLUG = "lower(replace(replace(n_name, ' ', ''), '-', ''))[1:12]"
_SEEDED = ", ".join(f"('{c}', '{t}', {n})" for c, counts in seed_counts().items() for t, n in counts.items())
#: Self-training in one pass: confident documents, by seeds, add their tokens to the counts of their category.
TRAINED = f"""lab AS (SELECT doc_id, category FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, {_ORDER}) AS k FROM topic) WHERE k = 1 AND probability > 0.35),
tok AS (SELECT doc_id, unnest(w) AS token FROM wrd),
mdl AS (SELECT category, token, sum(n) AS cnt FROM (SELECT category, token, count(*) AS n FROM lab JOIN tok USING (doc_id) GROUP BY ALL UNION ALL SELECT * FROM (VALUES {_SEEDED})) GROUP BY ALL),
siz AS (SELECT category, sum(cnt) AS total, (SELECT count(DISTINCT token) FROM mdl) + {SPARE_VOCABULARY} AS v FROM mdl GROUP BY category),
hit AS (SELECT doc_id, category, sum(ln(cnt + 1.0)) AS logs FROM tok JOIN mdl USING (token) GROUP BY ALL),
log AS (SELECT doc_id, category, coalesce(logs, 0) - len(w) * ln(CAST(total + v AS DOUBLE)) AS l FROM wrd CROSS JOIN siz LEFT JOIN hit USING (doc_id, category)),
exq AS (SELECT doc_id, category, exp(l - max(l) OVER (PARTITION BY doc_id)) AS e FROM log)"""
_HUNDRED = f"CAST(floor(round({_H} * 100) / 10 + 0.5) AS BIGINT)"
_SAID = [
    "CASE WHEN entity_id IS NULL THEN 'No professor data found' END",
    f"CASE WHEN entity_id IS NOT NULL AND {_H} >= 4 THEN name || ' is rated very difficult (' || {_HUNDRED} // 10 || '.' || {_HUNDRED} % 10 || '/5)' END",
    f"CASE WHEN would_take_again_pct >= 0 AND would_take_again_pct < 40 THEN 'Only ' || {_whole('would_take_again_pct')} || '% would retake with ' || name END",
    "CASE WHEN coalesce(good_prob, 0.5) < 0.4 THEN name || ' has low confidence rating - consider alternatives' END",
]
SQL |= {
    "school_totals": with_(*_BASE) + "SELECT count(*) AS total_professors, CAST(sum(num_ratings) AS BIGINT) AS total_reviews FROM ent",
    "professor_tags": with_(_TAGS) + f"SELECT entity_id, CAST(place AS INT) AS place, tag, count, greatest({num(0.25)}, CAST(count AS DOUBLE) / most) AS opacity FROM tags WHERE place < 5",
    "courses_search": SQL["courses"].replace(" GROUP BY upper(class_name)", " WHERE contains(upper(class_name), 'AND#2') GROUP BY upper(class_name)"),
    "first_courses": with_(REV, CLS) + "SELECT * FROM (SELECT entity_id, class_name, row_number() OVER (PARTITION BY entity_id ORDER BY num_reviews DESC, first_ordinal, class_name) AS class_place, num_reviews AS course_reviews FROM cls) WHERE class_place <= 8",
    "schedule_rows": with_(*_FULL) + f"SELECT course, {_PLACE}, {ROW}, class_name AS specific_class, course_rating AS specific_rating, course_reviews AS specific_reviews FROM cand",
    "optimizer_rows": with_(*_FULL, ranks("balanced")) + f"SELECT course, place, {ROW}, class_name, course_rating, course_reviews, optimizer_score, a_range, b_range, c_range, d_f FROM rk WHERE place <= 4",
    "top_categories": with_(TOPIC) + f"SELECT doc_id, category, probability, row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, {_ORDER}) AS place FROM topic WHERE probability >= 0.25",
    "topic_scores_trained": with_(TOPIC, TRAINED) + f"SELECT 'testdata' AS school, doc_id, category, {rnd('e / sum(e) OVER (PARTITION BY doc_id)', 4)} AS probability FROM exq",
    "fit_rows": with_(*_BASE, PROB, TOPIC, SENT, _WIDE) + f"SELECT {ROW}, fit_score, {_REASONS} AS fit_reasons, a_range, CASE WHEN fit_score >= 75 THEN 'high' WHEN fit_score >= 55 THEN 'medium' ELSE 'low' END AS ring FROM (SELECT *, {fit(**FIT_PREFS)} AS fit_score FROM ent LEFT JOIN wide USING (entity_id) LEFT JOIN prob USING (entity_id) WHERE num_ratings >= 3 ORDER BY fit_score DESC, ordinal LIMIT 100)",
    "detail_labels": with_(*_BASE, PROB, TOPIC, SENT, _WIDE)
    + f"SELECT entity_id, coalesce(array_to_string(list_filter([{', '.join(_FLAGS)}], lambda x: x IS NOT NULL), '|'), '') AS flags, CASE WHEN avg_rating >= 4 THEN 'High' WHEN avg_rating >= 3 THEN 'Average' ELSE 'Low' END AS quality, CASE WHEN {_H} >= 4.5 THEN 'Very challenging' WHEN {_H} >= 3.5 THEN 'Challenging' WHEN {_H} >= 2.5 THEN 'Moderate' WHEN {_H} >= 1.5 THEN 'Light' ELSE 'Very light' END AS difficulty, CASE WHEN would_take_again_pct >= 70 THEN 'Most would' WHEN would_take_again_pct >= 50 THEN 'About half' WHEN would_take_again_pct >= 0 THEN 'Most wouldn''t' ELSE 'Unknown' END AS retake, split_part(split_part({VERDICT}, '.', 1), ',', 1) AS short_verdict, array_to_string(list_transform(list_filter(string_split(name, ' '), lambda x: x <> ''), lambda x: x[1]), '') AS initials, {_whole('would_take_again_pct')} AS retake_text, {_DETAIL.format(LEVEL)} AS confidence_detail FROM ent LEFT JOIN wide USING (entity_id) LEFT JOIN prob USING (entity_id)",
    "comment_previews": "SELECT doc_id, CASE WHEN length(text) > 280 THEN substr(text, 1, 280) || '...' ELSE text END AS preview FROM documents",
    "appended_entities": "SELECT s_suppkey AS id, s_name AS name, s_suppkey AS num_ratings FROM supplier UNION ALL SELECT c_custkey, c_name, -1 FROM customer",
    "fetched_next": "SELECT s_suppkey AS id FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey WHERE coalesce(n, 0) < 595 AND s_suppkey >= 3",
    "selected_schools": f"SELECT CAST(place AS INT) AS place, a.slug, n_name AS name, n_name IS NOT NULL AS known FROM (VALUES (0, 'nation_3'), (1, 'nowhere'), (2, 'nation_1')) a(place, slug) LEFT JOIN nation ON {_SLUG} = a.slug",
    "run_counters": "SELECT count(*) FILTER (n_nationkey % 3 = 1) AS succeeded, count(*) FILTER (n_nationkey % 3 = 2) AS failed, count(*) FILTER (n_nationkey % 3 = 0) AS skipped FROM nation",
    "missing_schools": f"SELECT {_SLUG} AS slug, n_name AS name FROM nation WHERE n_nationkey % 3 = 0",
    "ingest_limits": with_(REV) + "SELECT entity_id, review_ordinal FROM (SELECT entity_id, review_ordinal, row_number() OVER (PARTITION BY entity_id ORDER BY review_ordinal) AS k FROM rev) WHERE k <= 20",
    "listing_rows": with_(*_BASE, _TAGS) + "SELECT entity_id, name AS \"lastName\", CASE WHEN entity_id % 5 > 0 THEN coalesce(department, 'Unknown') ELSE 'Unknown' END AS department, avg_rating AS \"avgRating\", num_ratings AS \"numRatings\", would_take_again_pct AS \"wouldTakeAgainPercent\", coalesce(n_tags, 0) AS n_tags, first_tag FROM ent LEFT JOIN (SELECT entity_id, count(*) AS n_tags, max(tag) FILTER (place = 0) AS first_tag FROM tags GROUP BY entity_id) USING (entity_id)",
    "sentiment_order": with_(REV, TOPIC, SENT) + f"SELECT entity_id, category, row_number() OVER (PARTITION BY entity_id ORDER BY n_reviews DESC, {_ORDER}) AS place FROM sent",
    "semester_warnings": with_(*_FULL, ranks("balanced"))
    + f"SELECT course, course || ': ' || said AS warning FROM (SELECT a.course, unnest(list_filter([{', '.join(_SAID)}], lambda x: x IS NOT NULL)) AS said FROM (SELECT unnest([{text(_CODES)}]) AS course) a LEFT JOIN (SELECT * FROM rk WHERE place = 1) b ON a.course = b.course)",
    "admitted_requests": """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (
  SELECT event_id, user_id, ts, i, true AS allowed, [t] AS held FROM e WHERE i = 1
  UNION ALL
  SELECT event_id, user_id, ts, i, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END
  FROM (SELECT e.*, list_filter(r.held, lambda x: e.t - x < 86400.0) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, allowed FROM r""",
}

SQL["schools_search"] = f"SELECT * FROM ({_SCHOOLS}) WHERE contains(lower(name), 'a')"
SQL["list_rows"] = with_(*_BASE, _TAGS) + f"SELECT {ROW}, top_tags FROM ent LEFT JOIN (SELECT entity_id, string_agg(tag || ':' || count, '|' ORDER BY place) AS top_tags FROM tags WHERE place < 5 GROUP BY entity_id) USING (entity_id) ORDER BY coalesce(avg_rating, 0) DESC, ordinal LIMIT 200"
