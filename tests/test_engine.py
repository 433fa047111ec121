"""The review engine: golden values of the sample document, edge rows, properties, and SQL side by side."""

from __future__ import annotations

import json
import math
import os
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.functions import labels, scalars
from tarnwell.operators import merging, posterior, rollups, topics, trend
from tarnwell.plans import analyze, catalog, endpoints
from tarnwell.sources import remote, schools
from tarnwell.streaming import admission, ingest

REVIEW = (
    "school string, entity_ordinal int, entity_id string, review_ordinal int, class_name string, date string, comment string, clarity double, helpful double, "
    "difficulty double, would_take_again int, grade string, thumbs_up int, thumbs_down int"
)


def review(entity="e", n=0, **over):
    base = {"school": "s", "entity_ordinal": 0, "entity_id": entity, "review_ordinal": n, "class_name": "A1", "date": "2020-01-01 00:00:00 +0000 UTC", "comment": "", "clarity": 5.0, "helpful": 5.0, "difficulty": 3.0, "would_take_again": 1, "grade": "A", "thumbs_up": 0, "thumbs_down": 0}
    return tuple((base | over).values())


def frame(spark, rows):
    return spark.createDataFrame(rows, REVIEW)


def test_seed_facts():
    counts = topics.seed_counts()
    assert [sum(counts[c].values()) for c in topics.CATEGORIES] == [114, 102, 90, 78, 90]
    assert [len(counts[c]) for c in topics.CATEGORIES] == [34, 34, 30, 24, 29]
    assert len(set().union(*counts.values())) == 150 and len(scalars.STOPWORDS) == len(set(scalars.STOPWORDS))


def test_seed_scores_agree_with_the_plain_classifier(spark):
    texts = ["The exam and the quiz were fair", "office hours! helpful, helpful", "", None, "the a of", "zzz yyy", "homework homework lab essay"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, comment string")
    native = {r["i"]: {x["category"]: x["probability"] for x in r["p"]} for r in df.select("i", topics.seed_scores("comment").alias("p")).collect()}
    joined: dict = {}
    for r in topics.scores(df, topics.seed_model(spark), ("i",)).collect():
        joined.setdefault(r["i"], {})[r["category"]] = r["probability"]
    counts = topics.seed_counts()
    totals = {c: sum(n.values()) for c, n in counts.items()}
    for r in df.select("i", scalars.tokens("comment").alias("w")).collect():
        likely = {c: math.prod(Fraction(counts[c][w] + 1, totals[c] + 150 + 1000) for w in r["w"]) for c in topics.CATEGORIES}
        want = {c: round(float(p / sum(likely.values())), 4) for c, p in likely.items()}
        assert topics.TopicCounts().posterior(r["w"]).tolist() == pytest.approx(list(want.values()), abs=1e-9)
        assert native[r["i"]] == pytest.approx(want, abs=1e-4) and joined[r["i"]] == pytest.approx(want, abs=1e-4)
        assert sum(want.values()) == pytest.approx(1, abs=5e-4)


def test_posterior_edges(spark):
    rows = [review("zero", clarity=0.0), review("null", clarity=None, helpful=None), review("mixed", clarity=4.0, helpful=0.0, would_take_again=-1)]
    got = {r["entity_id"]: r for r in posterior.rating_counts(frame(spark, rows)).select("entity_id", posterior.rating_posteriors().alias("p"), posterior.retake_posterior().alias("w"), posterior.sub_rating("clarity").alias("c")).collect()}
    for e in ("zero", "null", "mixed"):
        g = got[e]["p"]["good"]
        assert (g["alpha"], g["beta"], g["mean"], g["variance"], g["std"], g["ci_lower"], g["ci_upper"]) == (2, 2, 0.5, 0.05, None, 0.0, 1.0)
    assert got["mixed"]["w"] is None and got["zero"]["c"] is None and got["mixed"]["c"]["raw_mean"] == 4.0


def test_posterior_properties(spark):
    rows = spark.range(0, 60).select((F.col("id") % 12).alias("s"), (F.col("id") % 12 + F.col("id")).alias("n"))
    for r in rows.select("s", "n", posterior.posterior(F.col("s"), F.col("n"), 3.5).alias("p")).collect():
        p = r["p"]
        assert 0 <= p["ci_lower"] <= p["mean"] <= p["ci_upper"] <= 1 and p["n_ratings"] == r["n"]


def test_grades(spark):
    rows = [review("e", i, grade=g) for i, g in enumerate(["Pass", "WD", "", "Incomplete", "A-", "B", None, "C+"])]
    df = frame(spark, rows)
    r = rollups.grade_probabilities(df).first()
    assert (r["a_range"], r["b_range"], r["c_range"], r["d_f"], r["n_grades"]) == (20.0, 20.0, 20.0, 40.0, 5)
    assert {x["grade"] for x in rollups.class_grades(df).collect()} <= {"Pass", "WD", "Incomplete", "A-", "B", "C+"}
    assert [x["grade"] for x in rollups.grade_histogram(rollups.grade_distribution(df)).orderBy("best_first").collect()] == ["A-", "B", "C+"]


def test_class_breakdown_strips_and_keeps_pairs(spark):
    rows = [review("e", 0, class_name=" X1\t", clarity=4.0, helpful=0.0), review("e", 1, class_name="X1", clarity=None, helpful=None), review("e", 2, class_name="Y2"), review("e", 3, class_name=None)]
    got = rollups.class_breakdown(frame(spark, rows)).collect()
    assert [(r["class_name"], r["num_reviews"], r["avg_rating"]) for r in got] == [("X1", 2, 4.0)]


def test_highlights(spark):
    long = "x" * 400
    rows = [review("e", 0, comment=long, thumbs_up=1), review("e", 1, comment=long, date="bad"), review("e", 2, comment="short"), review("e", 3, comment=long, thumbs_up=1), review("e", 4, comment=None)]
    got = rollups.highlights(frame(spark, rows), "2020-12-31 00:00:00").orderBy("rank").collect()
    assert [r["review_ordinal"] for r in got] == [0, 3, 1]
    assert got[0]["score"] == pytest.approx(1 + 2 + 3 - 365 / 365) and got[2]["score"] == 2.0


def test_trend(spark):
    rows = [review("one", 0), review("bad", 0, date="x"), review("bad", 1, clarity=None, helpful=None)]
    rows += [review("two", 0, clarity=4.0, helpful=0.0), review("two", 1, clarity=None)]
    got = {r["entity_id"]: r for r in trend.rating_trend(frame(spark, rows)).collect()}
    assert got["one"]["insufficient_data"] and got["one"]["n_reviews_with_dates"] == 1
    assert got["bad"]["insufficient_data"] and got["bad"]["n_reviews_with_dates"] == 0 and got["bad"]["pred_mean"] is None
    assert got["two"]["n_data_points"] == 2 and not got["two"]["capped"]
    # closed form for two equal times: mean = k / (2k + noise) * (y1 + y2) with k = 1
    y = 2.0 + 5.0
    assert got["two"]["pred_mean"][0] == pytest.approx(y / (2 + trend.NOISE), abs=1e-3)
    mean, std = trend.regress(np.array([0.0, 3.0]), np.array([4.0, 5.0]), np.linspace(0, 3, 5))
    k = np.array([[1 + 0.8, math.exp(-9 / 72)], [math.exp(-9 / 72), 1 + 0.8]])
    assert mean[0] == pytest.approx(np.array([1.0, math.exp(-9 / 72)]) @ np.linalg.inv(k) @ np.array([4.0, 5.0])) and (std > 0).all()
    capped = trend.rating_trend(frame(spark, [review("e", i, date=f"2020-0{i + 1}-01 00:00:00") for i in range(5)]), most=3).first()
    assert capped["capped"] and capped["n_data_points"] == 3


@pytest.mark.parametrize("n,span", [(2, 5), (60, 59), (500, 2500), (300, 15000), (900, 6000), (40, 40000)])
def test_trends_by_features_are_those_of_the_matrix(n, span):
    rng = np.random.default_rng(n)
    days = np.sort(np.r_[0, span, rng.choice(np.arange(1, span), n - 2, replace=False)]).astype(float)
    times, y = rng.integers(1, 4, n).astype(float), rng.integers(1, 6, n).astype(float)
    grid = np.linspace(0.0, max(days[-1] / trend.MONTH_DAYS, 12.0), trend.POINTS)
    want = trend.regress(days / trend.MONTH_DAYS, y, grid, noise=trend.NOISE / times)
    got = trend.regress_days(days, y, grid, trend.NOISE / times)
    assert np.abs(want[0] - got[0]).max() < 1e-10 and np.abs(want[1] - got[1]).max() < 1e-10
    x = np.linspace(0, grid[-1], 77)
    assert np.abs(trend.features(x, grid[-1]) @ trend.features(x, grid[-1]).T - np.exp(-((x[:, None] - x) ** 2) / (2 * trend.LENGTH**2))).max() < 1e-12


def test_trends_without_lists(spark):
    df = frame(spark, [review("e", i, date=f"2020-0{i + 1}-01 00:00:00") for i in range(5)] + [review("one", 0)])
    whole = {r["entity_id"]: r.asDict() for r in trend.rating_trend(df).collect()}
    for r in trend.rating_trend(df, lists=False).collect():
        assert r.asDict() == {k: v for k, v in whole[r["entity_id"]].items() if k not in ("train_dates", "train_ratings")}


def test_trend_label_hole(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0, 1.0 + 2.0**-2 + 0.05],), ([4.0] * 8,), (None,), ([1.0, 1.0],)], "m array<double>")
    got = [r[0] for r in df.select(labels.trend_label(F.col("m"))).collect()]
    assert got[1:] == ["Consistently highly rated", "Not enough data", "Not enough data"]


def rows_for_endpoints(spark):
    data = [
        (0, "a", "Ann Lee", "Math", 4.5, 2.0, 30, 90.0, 0.9, 70.0), (1, "b", "Bo Ray", None, 4.5, 4.0, 5, -1.0, 0.3, None), (2, "c", "Cy%", "Ma_th", 0.0, None, 2, None, None, 0.0),
        (3, "d", "Di", "Art", 3.0, 3.0, 15, 0.0, 0.5, 50.0),
    ]
    schema = "ordinal int, entity_id string, name string, department string, avg_rating double, avg_difficulty double, num_ratings int, would_take_again_pct double, good_prob double, a_range double"
    df = spark.createDataFrame(data, schema)
    return df.withColumns({"legacy_id": F.lit(1), "school": F.lit("s"), "b_range": F.lit(0.0), "c_range": F.lit(0.0), "d_f": F.lit(0.0), "pct_grading": F.lit(80.0), "pct_lectures": F.when(F.col("ordinal") == 0, 30.0), "pct_approachability": F.lit(72.5), "pct_workload": F.lit(None).cast("double")})


def test_listing(spark):
    df = rows_for_endpoints(spark)
    ids = lambda x: [r["entity_id"] for r in x.collect()]
    assert ids(endpoints.list_professors(df)) == ["a", "b", "d", "c"]
    assert ids(endpoints.list_professors(df, sort_by="no such")) == ["a", "b", "d", "c"]
    assert ids(endpoints.list_professors(df, sort_by="name")) == ["a", "b", "c", "d"]
    assert ids(endpoints.list_professors(df, search="%")) == ["c"] and ids(endpoints.list_professors(df, department="_")) == ["c"]
    assert ids(endpoints.compare(df, "d, a,zz")) == ["a", "d"]
    with pytest.raises(ValueError):
        endpoints.list_professors(df, limit=501)
    assert rollups.school_stats(df).first()["departments"] == 4


def test_fit(spark):
    got = endpoints.fit(rows_for_endpoints(spark), difficulty=1, grading=1, lectures=5, approachability=4, workload=3).collect()
    assert [r["entity_id"] for r in got if r["entity_id"] == "c"] == []
    a = next(r for r in got if r["entity_id"] == "a")
    score = (75 * 2 + 80 * 0.5 + 30 * 0.6 * 2.5 + 72.5 * 2.5 + 90 * 1.5 + 90) / (2 + 0.5 + 2.5 + 2.5 + 1.5 + 1)
    assert a["fit_score"] == pytest.approx(round(score, 1))
    assert a["fit_reasons"] == ["Low difficulty matches your preference", "Lectures may not match your expectations (30% positive)", "Highly approachable (72% positive)"]
    with pytest.raises(ValueError):
        endpoints.fit_score(difficulty=6)


def test_courses_and_plans(spark):
    base = rows_for_endpoints(spark)
    classes = spark.createDataFrame([("a", "math 101", 6, 4.0, 1), ("b", "MATH", 3, None, 1), ("d", "Art-2", 12, 3.0, 1)], "entity_id string, class_name string, course_reviews int, course_rating double, class_place int").join(base, "entity_id")
    asked = "math 101, ,Math 101,none"
    got = endpoints.schedule(classes, asked).collect()
    assert [(r["course"], r["entity_id"], r["place"]) for r in sorted(got, key=lambda r: r["place"])] == [("MATH 101", "b", 1), ("MATH 101", "a", 2)]
    ranks = endpoints.ranked(classes, asked, "easy")
    best = endpoints.recommended(ranks).first()
    assert best["entity_id"] == "a" and best["optimizer_score"] == pytest.approx(round((0.9 * 0.2 + 0.6 * 0.35 + 0.7 * 0.25 + 0.9 * 0.2) * 0.9, 4))
    s = endpoints.semester(ranks, asked).first()
    assert (s["num_courses"], s["courses_with_data"], s["difficulty_label"], s["estimated_gpa"]) == (3, 1, "Light semester", 2.66)
    assert [r["warning"] for r in endpoints.warnings(ranks, asked).collect()] == ["NONE: No professor data found"]
    nothing = endpoints.semester(endpoints.ranked(classes, "zzz"), "zzz").first()
    assert nothing["difficulty_label"] == "Not enough data" and nothing["estimated_gpa"] is None
    plan = endpoints.candidates(classes, "math")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "Python" not in plan


def test_courses_keep_repeats(spark):
    c = spark.createDataFrame([(0, "Ann", " m1 ", 3), (0, "Ann", "M1", 2), (1, "Bo", "m1", 1), (1, "Bo", "z", 9)], "ordinal int, name string, class_name string, num_reviews int")
    got = rollups.course_rows(c).collect()
    assert [(r["course"], r["professors"], r["total_reviews"]) for r in got] == [("Z", ["Bo"], 9), ("M1", ["Ann", "Ann", "Bo"], 6)]


def test_labels(spark):
    df = spark.createDataFrame([(0.9, 4.5, 2.4, 10.0), (None, None, None, None), (0.44, 1.5, 0.0, -1.0)], "g double, d double, r double, w double")
    got = df.select(labels.letter_grade(F.col("g")).alias("l"), labels.difficulty_label(F.col("d"), True).alias("d"), labels.detail_flags(F.col("r"), F.col("d"), F.col("w"), F.lit("x declining"), F.lit(20.0)).alias("f"), labels.bottom_line(F.col("r"), F.col("d"), F.lit(None).cast("double"), F.col("w")).alias("b")).collect()
    assert [r["l"] for r in got] == ["A+", "?", "C"] and got[0]["d"] == "Very challenging" and got[2]["d"] == "Light"
    assert got[0]["f"] == ["10% of students would retake", "Below average overall rating", "High difficulty level", "Lecture quality rated below average", "Ratings have been trending down recently"]
    assert got[2]["f"] == ["Lecture quality rated below average", "Ratings have been trending down recently"] and got[1]["b"]["retake"] == "Unknown"


def test_admission_batch_and_stream(spark, sf_dir, tmp_path):
    assert admission.admit([0, 1, 2, 59, 60, 61, 62], [], 2, 60)[0] == [True, True, False, False, True, True, False]
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch = {r["event_id"]: r["allowed"] for r in admission.admitted(events, limit=3, window=86400.0).collect()}
    assert not all(batch.values())
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = admission.admitted_stream(stream, limit=3, window=86400.0).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["event_id"]: r["allowed"] for r in spark.table("admitted").collect()} == batch


def test_merging(spark):
    known = spark.createDataFrame([(0, "a", [1], 5), (1, "b", [], 5), (2, "c", [], 1)], "ordinal int, id string, reviews array<int>, num_ratings int")
    fetched = spark.createDataFrame([("b", [2], 5), ("c", [], 1), ("d", [3], 1)], "id string, reviews array<int>, num_ratings int")
    got = merging.upserted(known, fetched).orderBy("ordinal").collect()
    assert [(r["id"], r["reviews"]) for r in got] == [("a", [1]), ("b", [2]), ("c", []), ("d", [3])]
    assert [r["id"] for r in merging.refetch_candidates(known).collect()] == ["b"]
    found = spark.createDataFrame([("a", 1), ("n", 2), ("n", 2), ("o", 0)], "id string, num_ratings int")
    assert [r["id"] for r in merging.unknown(found, known).collect()] == ["n"]
    assert tuple(merging.totals(known).first()) == (3, 1)
    cat, files = spark.createDataFrame([("x", "X"), ("y", "Y")], "slug string, name string"), spark.createDataFrame([("x", False, 1, 2)], "slug string, readable boolean, professors int, reviews int")
    assert [(r["slug"], r["status"]) for r in merging.catalog_status(cat, files).collect()] == [("x", "Error"), ("y", "Not scraped")]
    assert [r["slug"] for r in merging.selected(cat, files, "missing").collect()] == ["y"] and merging.selected(cat, files, "all").count() == 2


def test_discovery_and_documents(spark, tmp_path):
    meta = {"school_name": "One", "total_professors": 2, "total_reviews": 7}
    (tmp_path / "one_analyzed.json").write_text(json.dumps({"metadata": meta, "analysis": []}))
    (tmp_path / "two_analyzed.json").write_text('{"metadata": {"school_name": "Two"')
    (tmp_path / "three_analyzed.json").write_text('{"analysis": []}')
    got = [tuple(r) for r in schools.discover(spark, str(tmp_path)).collect()]
    assert got == [("one", "One", 2, 7), ("two", "two", 0, 0)]
    assert schools.default_slug(schools.discover(spark, str(tmp_path))) == "one"
    (tmp_path / "empty.json").write_text(json.dumps({"metadata": {}, "professors": []}))
    raw = schools.read_raw(spark, str(tmp_path / "empty.json"))
    assert raw.first()["school"] == "empty" and schools.entities(raw).count() == 0 and schools.reviews(raw).count() == 0
    schools.write_analyzed(spark.createDataFrame([("s", 1), ("t", 2)], "school string, x int"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("school = 't'").first()["x"] == 2


def test_school_cache(spark):
    now, calls = [0.0], []
    cache = schools.SchoolCache(lambda s: spark.range(1), lambda: calls.append(1) or ["a"], most=2, clock=lambda: now[0])
    for s in ("a", "b", "a", "c"):
        cache.get(s)
    assert list(cache.held) == ["a", "c"]
    cache.list(), cache.list()
    now[0] = 301.0
    cache.list()
    assert len(calls) == 2


def test_remote_pages_and_retries():
    waits, answers = [], [(429, {}), (500, {}), (200, {"data": {"c": {"edges": [{"node": {"id": 1}}, {"node": {"id": 2}}], "pageInfo": {"hasNextPage": True, "endCursor": "z"}}}}), (200, {"data": {"c": {"edges": [{"node": {"id": 3}}], "pageInfo": {}}}})]
    bodies = []
    post = lambda body: (bodies.append(body), answers.pop(0))[1]
    assert [n["id"] for n in remote.pages(post, "q", {}, ("c",), sleep=waits.append)] == [1, 2, 3]
    assert waits == [2, 2] and bodies[-1]["variables"]["cursor"] == "z"
    assert remote.fetch(lambda b: (429, {}), {}, waits.append) == {} and waits[2:] == [2, 3, 5, 9]
    assert len(remote.search_terms()) == 702


def test_native_plans_have_no_python(spark, sf_dir):
    for name in ("list_professors", "rating_posteriors", "grade_probabilities", "optimize_balanced", "topic_scores", "fit"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_side_by_side(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    want, got = con.sql(catalog.SQL[name]).df(), catalog.QUERIES[name](spark, sf_dir).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (got, want))
    assert len(a) == len(b)
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_queries_without_sql_are_known_and_give_rows(spark, sf_dir):
    without = sorted(catalog.QUERIES.keys() - catalog.SQL.keys())
    assert without == ["rating_trend", "topic_model_serial"]  # held to plain versions in test_analysis.py
    for name in without:
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_merge_stream(spark, tmp_path):
    schema = "id string, name string, reviews array<int>"
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.merge_stream(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "state")).awaitTermination()
        return {r["id"]: (r["name"], r["reviews"]) for r in ingest.current(spark, target).collect()}

    assert feed([("a", "A", [1]), ("b", "B", [])]) == {"a": ("A", [1]), "b": ("B", [])}
    assert feed([("b", "B2", [2]), ("c", "C", [3]), ("a", "A2", [])]) == {"a": ("A", [1]), "b": ("B2", [2]), "c": ("C", [3])}
    assert ingest.versions(spark, target) == [1, 2]
    ingest.merge_batch(spark.createDataFrame([("d", "D", [4]), ("n", "N", []), ("b", "worse", []), ("b", "B2", [2])], schema), target, 2)
    assert {r["id"]: r["name"] for r in ingest.current(spark, target).collect()} == {"a": "A", "b": "B2", "d": "D", "n": "N"}
    ingest.merge_batch(spark.createDataFrame([("a", "A3", [1, 2])], schema), target, 3)
    assert ingest.versions(spark, target) == [2, 3]  # what the newest was merged from stays, older ones go


def test_front_helpers(spark):
    df = rows_for_endpoints(spark)
    assert [r["entity_id"] for r in endpoints.suggestions(df, "art").collect()] == ["d"] and endpoints.suggestions(df, "a").count() == 0
    assert [r["entity_id"] for r in endpoints.suggestions(df, "ma", chosen=("a",)).collect()] == ["c"]
    with pytest.raises(ValueError):
        endpoints.comparable(["x", "x"])
    tags = spark.createDataFrame([([("x", 8), ("y", 1)],)], "t array<struct<tag:string,count:int>>")
    assert [tuple(x) for x in tags.select(endpoints.top_tags(F.col("t"))).first()[0]] == [("x", 8, 1.0), ("y", 1, 0.25)]
    assert [r[0] for r in endpoints.school_list(spark.createDataFrame([("b", "B 1"), ("a", "A 1"), ("c", "C")], "slug string, name string"), "1", pinned="b").collect()] == ["b", "a"]
    assert [r[0] for r in spark.createDataFrame([("Di  Mo",)], "n string").select(labels.initials(F.col("n"))).collect()] == ["DM"]
    assert labels.GRADE_ORDER[0] == "A+"


def test_bench_takes_every_registered_query_unless_told_otherwise():
    import __spark_entry__
    import bench

    found = __spark_entry__.queries()
    assert bench.selected(found, None) == found and set(catalog.QUERIES) <= set(found)
    assert set(bench.selected(found, "headline")) <= set(bench.HEADLINE)
    assert list(bench.selected(found, "fit,courses")) == ["fit", "courses"]


def test_scores_are_the_same_whatever_is_broadcast(spark, monkeypatch):
    texts = ["exam exam quantum", "the a", None, "homework zebra lecture zebra", "quantum", "nothing of it known here", ""]
    df = spark.createDataFrame([(s, i, t) for s in ("a", "b") for i, t in enumerate(texts)], "school string, i int, comment string")
    found = []
    for frequent in (1, topics.FREQUENT, 1 << 40):  # none, some, all tokens of the model
        monkeypatch.setattr(topics, "FREQUENT", frequent)
        found.append({tuple(r) for r in topics.scores(df, topics.train_batch(df.where("i < 5")), ("school", "i"), partition=("school",)).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 2 * len(texts) * len(topics.CATEGORIES)
