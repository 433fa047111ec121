"""The whole analysis against a plain version of it, over generated documents; serial training; trends; sources end to end."""

from __future__ import annotations

import json
import math
import random
import re
import threading
from collections import Counter
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.functions import labels, scalars
from tarnwell.operators import merging, topics, trend
from tarnwell.plans import analyze, catalog
from tarnwell.sources import remote, schools, testdata
from tarnwell.streaming import admission

WORDS = "exam quiz homework lecture slides helpful rude grade curve harsh final reading boring unclear notes midterm kind email paper project zebra quantum river".split()


def generated(seed, school):
    """A raw document as the scraper writes it: missing values, bad dates, odd grades, repeated categories."""
    rng = random.Random(seed)
    start, people = datetime(2015, 3, 1), []
    for p in range(6):
        reviews = []
        for k in range((0, 1, 2, 9, 25, 40)[p]):
            day = start + timedelta(days=rng.randrange(2500), hours=rng.randrange(24))
            reviews.append({
                "id": f"r{p}-{k}", "class_name": rng.choice(["M1", " M1", "H 2", "", None]), "date": rng.choice([day.strftime("%Y-%m-%d %H:%M:%S +0000 UTC")] * 6 + ["bad", None]),
                "comment": rng.choice([None, "", "the a of"] + [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30))) for _ in range(6)]),
                "helpful_rating": rng.choice([None, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), "clarity_rating": rng.choice([None, 1.0, 2.0, 3.0, 4.0, 5.0]), "difficulty_rating": rng.choice([None, 0.0, 2.0, 4.0, 5.0]),
                "rating_tags": "", "would_take_again": rng.choice([None, -1, 0, 1, 1]), "grade": rng.choice(["A", "A-", "B+", "C", "F", "", "Incomplete", "WD", None]), "is_online": False, "is_for_credit": True,
                "attendance_mandatory": "", "thumbs_up": rng.choice([None, 0, 3]), "thumbs_down": rng.choice([None, 0, 1]),
            })
        people.append({
            "id": f"p{p}", "legacy_id": p, "first_name": "N", "last_name": f"\u00e9{p}", "department": rng.choice([None, "Math"]), "avg_rating": rng.choice([0.0, 3.4, 4.6]), "avg_difficulty": rng.choice([None, 2.2, 4.4]),
            "num_ratings": len(reviews), "would_take_again_pct": -1.0, "top_tags": rng.choice([None, [{"tag": "t", "count": 2}]]), "reviews": reviews,
        })
    return {"metadata": {"school_name": school, "total_professors": len(people), "total_reviews": sum(len(p["reviews"]) for p in people)}, "professors": people}


def plain_words(text):
    return [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) > 1 and w not in scalars.STOPWORDS]


class PlainModel:
    """Naive Bayes with keyword seeds, written anew: counts by category, add-one smoothing over the words met and 1000 more."""

    def __init__(self):
        self.n = {c: Counter() for c in topics.SEEDS}
        for c, phrases in topics.SEEDS.items():
            for phrase in phrases:
                for w in phrase.split():
                    self.n[c][w] += 3

    def told(self, words):
        if not words:
            return {c: 0.2 for c in self.n}
        met = {w for c in self.n.values() for w in c}
        logs = {c: sum(math.log((n[w] + 1) / (sum(n.values()) + len(met) + 1000)) for w in words) for c, n in self.n.items()}
        top = max(logs.values())
        e = {c: math.exp(x - top) for c, x in logs.items()}
        return {c: round(x / sum(e.values()), 4) for c, x in e.items()}

    def learn(self, words):
        if words and max((p := self.told(words)).values()) > 0.35:
            best = max(p.values())
            self.n[next(c for c in self.n if p[c] == best)].update(words)


def plain_trend(dated):
    """Prior mean 0, squared-exponential kernel of 6 months, noise 0.8, every review a row of the matrix; by plain inversion."""
    dated = sorted(dated, key=lambda x: x[0])
    x = np.array([(d - dated[0][0]).days / 30.44 for d, _ in dated])
    y = np.array([r for _, r in dated])
    at = np.linspace(0, 12.0 if x.max() - x.min() < 1 else x.max() - x.min(), 20)
    k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2) / 72.0)
    inverse = np.linalg.inv(k(x, x) + 0.8 * np.eye(len(x)))
    return k(at, x) @ inverse @ y, np.sqrt(np.maximum(1.0 - np.einsum("ij,jk,ik->i", k(at, x), inverse, k(at, x)), 1e-6))


def present(*xs):
    xs = [x for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def dated_of(reviews):
    out = []
    for r in reviews:
        try:
            day = datetime.strptime((r["date"] or "")[:19], "%Y-%m-%d %H:%M:%S")
        except ValueError:
            continue
        if (x := present(r["clarity_rating"], r["helpful_rating"])) is not None:
            out.append((day, x))
    return out


@pytest.fixture(scope="module")
def documents(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    docs = {s: generated(k, s) for k, s in enumerate(("one", "two"))}
    for s, d in docs.items():
        (folder / f"{s}.json").write_text(json.dumps(d, ensure_ascii=False), encoding="utf-8")
    return str(folder), docs


@pytest.fixture(scope="module")
def analyzed(spark, documents):
    raw = schools.read_raw(spark, f"{documents[0]}/*.json")
    rows = analyze.analyze(schools.entities(raw), schools.reviews(raw), "2026-02-01 00:00:00")
    rows.persist()
    return {(r["school"], r["entity_id"]): r for r in rows.collect()}, rows


def people(documents):
    return [(s, p) for s, d in documents[1].items() for p in d["professors"]]


def test_every_professor_is_analyzed_once(analyzed, documents):
    assert analyzed[0].keys() == {(s, p["id"]) for s, p in people(documents)} and analyzed[1].count() == 12
    for s, p in people(documents):
        r = analyzed[0][s, p["id"]]
        assert r["name"] == f"N {p['last_name']}" and r["department"] == (p["department"] or "Unknown") and [tuple(t) for t in r["top_tags"]] == [(t["tag"], t["count"]) for t in p["top_tags"] or []]


def test_posteriors_and_grades(analyzed, documents):
    for s, p in people(documents):
        r = analyzed[0][s, p["id"]]
        both = [(x["clarity_rating"] + x["helpful_rating"]) / 2 for x in p["reviews"] if x["clarity_rating"] and x["helpful_rating"]]
        good = r["rating_posteriors"]["good"]
        a, b = 2 + sum(x >= 3.5 for x in both), 2 + sum(x < 3.5 for x in both)
        assert (good["alpha"], good["beta"], good["n_ratings"]) == (a, b, len(both)) and good["mean"] == pytest.approx(a / (a + b), abs=6e-5)
        yes = [x["would_take_again"] for x in p["reviews"] if x["would_take_again"] in (0, 1)]
        w = r["would_take_again_posterior"]
        assert (w is None) == (not yes) and (not yes or w["alpha"] == 2 + sum(yes))
        told = [g for x in p["reviews"] if (g := x["grade"]) and g not in labels.NO_GRADE]
        share = lambda f: round(100 * sum(map(f, told)) / len(told), 1) if told else 0.0  # noqa: B023, E731
        assert r["grade_probabilities"]["a_range"] == pytest.approx(share(lambda g: g[0] == "A"), abs=0.11)
        assert r["grade_probabilities"]["d_f"] == pytest.approx(share(lambda g: g[0] not in "ABC"), abs=0.11)
        assert {g["grade"]: g["n"] for g in r["grade_distribution"] or []} == Counter(told)
        classes = Counter(c.strip() for x in p["reviews"] if (c := x["class_name"]) and c.strip())
        assert {c["class_name"]: c["num_reviews"] for c in r["class_breakdown"] or []} == {c: n for c, n in classes.items() if n >= 2}


def test_serial_training_and_sentiment(spark, analyzed, documents):
    raw = schools.read_raw(spark, f"{documents[0]}/*.json")
    got = {}
    for r in topics.train(schools.reviews(raw)).collect():
        got.setdefault(r["school"], {}).setdefault(r["category"], {})[r["token"]] = r["cnt"]
    for s, d in documents[1].items():
        model = PlainModel()
        for p in d["professors"]:
            for x in p["reviews"]:
                model.learn(plain_words(x["comment"]))
        assert got[s] == {c: dict(n) for c, n in model.n.items()}
        for p in d["professors"]:
            by = {}
            for x in p["reviews"]:
                rating = present(x["clarity_rating"], x["helpful_rating"])
                if x["comment"] and rating is not None:
                    for c, q in model.told(plain_words(x["comment"])).items():
                        if q >= 0.25:
                            by.setdefault(c, []).append(rating)
            told = analyzed[0][s, p["id"]]["category_sentiment"] or {}
            assert {c: v["n_reviews"] for c, v in told.items()} == {c: len(v) for c, v in by.items()}
            for c, v in by.items():
                assert told[c]["mean_sentiment"] == pytest.approx(sum(v) / len(v), abs=5.1e-3) and told[c]["pct_positive"] == pytest.approx(100 * sum(x >= 3.5 for x in v) / len(v), abs=0.051)


def test_serial_training_of_the_registered_query(spark, sf_dir):
    got = {}
    for r in catalog.QUERIES["topic_model_serial"](spark, sf_dir).collect():
        got.setdefault(r["category"], {})[r["token"]] = r["cnt"]
    model = PlainModel()
    for r in testdata.read(spark, sf_dir, "documents").orderBy("doc_id").collect():
        words = plain_words(r["text"])
        met = {w for c in model.n.values() for w in c}
        scale = {c: math.log(sum(n.values()) + len(met) + 1000) for c, n in model.n.items()}
        logs = {c: sum(math.log(n[w] + 1) - scale[c] for w in words) for c, n in model.n.items()}
        e = {c: math.exp(x - max(logs.values())) for c, x in logs.items()}
        p = {c: round(x / sum(e.values()), 4) for c, x in e.items()}
        if words and max(p.values()) > 0.35:
            model.n[max(p, key=p.get)].update(words)
    assert got == {c: dict(n) for c, n in model.n.items()}


def test_trends_labels_and_verdicts(analyzed, documents):
    seen = set()
    for s, p in people(documents):
        r, dated = analyzed[0][s, p["id"]], dated_of(p["reviews"])
        g = r["gp_trend"]
        seen.add(g["insufficient_data"])
        assert g["insufficient_data"] == (len(dated) < 2)
        if len(dated) < 2:
            assert g["n_reviews_with_dates"] == len(dated) and r["trend_summary"] == "Not enough data"
            continue
        mean, std = plain_trend(dated)
        assert g["pred_mean"] == pytest.approx(mean, abs=1.1e-3) and g["pred_std"] == pytest.approx(std, abs=1.1e-3) and g["n_data_points"] == len(dated)
        assert g["pred_ci_lower"] == pytest.approx([max(1.0, m - 1.96 * d) for m, d in zip(mean, std, strict=True)], abs=4e-3)
        assert g["pred_ci_upper"] == pytest.approx([min(5.0, m + 1.96 * d) for m, d in zip(mean, std, strict=True)], abs=4e-3)
        diff = mean[-5:].mean() - mean[:5].mean()
        if abs(diff) > 0.5:
            assert r["trend_summary"] == ("Significantly improving over time" if diff > 0 else "Declining over time")
            assert r["verdict"].endswith("improving recently" if diff > 0 else "been declining")
    assert seen == {True, False}


def test_trends_of_the_registered_query(spark, sf_dir):
    by = {}
    for r in testdata.reviews(spark, sf_dir).select("entity_id", "date", F.col("clarity").alias("clarity_rating"), F.col("helpful").alias("helpful_rating")).collect():
        by.setdefault(r["entity_id"], []).append(r)
    got = {r["entity_id"]: r for r in catalog.QUERIES["rating_trend"](spark, sf_dir).collect()}
    assert got.keys() == by.keys()
    for e, reviews in by.items():
        dated = dated_of(reviews)
        mean, std = plain_trend(dated)
        assert got[e]["n_data_points"] == len(dated) and (got[e]["last_mean"], got[e]["last_std"]) == (pytest.approx(mean[-1], abs=2e-3), pytest.approx(std[-1], abs=2e-3))


def test_ratings_of_one_day_enter_as_their_mean():
    x, y = np.array([0.0, 0.0, 0.0, 2.0]), np.array([1.0, 5.0, 3.0, 4.0])
    whole = trend.regress(x, y, np.linspace(0, 3, 5))
    folded = trend.regress(np.array([0.0, 2.0]), np.array([3.0, 4.0]), np.linspace(0, 3, 5), noise=np.array([0.8 / 3, 0.8]))
    assert np.allclose(whole[0], folded[0]) and np.allclose(whole[1], folded[1])


def test_highlights_of_the_analysis(analyzed, documents):
    for s, p in people(documents):
        best = analyzed[0][s, p["id"]]["review_highlights"] or []
        long = sorted(len(c.strip()) for x in p["reviews"] if (c := x["comment"]) and len(c.strip()) >= 30)
        assert len(best) == min(5, len(long)) and [h["score"] for h in best] == sorted((h["score"] for h in best), reverse=True)


def test_analyzed_and_raw_tables_are_read_back(spark, analyzed, documents, tmp_path):
    path = str(tmp_path / "analyzed")
    schools.write_analyzed(analyzed[1], path)
    back = schools.read_analyzed(spark, path, "two")
    assert back.count() == 6 and re.search(r"PartitionFilters: \[[^\]]*school", back._jdf.queryExecution().executedPlan().toString())
    with pytest.raises(schools.UnknownSchool):
        schools.read_analyzed(spark, path, "three")
    raw = schools.read_raw(spark, f"{documents[0]}/*.json")
    schools.write_raw(raw, str(tmp_path / "again"))
    again = spark.read.schema(schools.RAW).json(str(tmp_path / "again" / "school=one"))
    assert again.first()["professors"] == raw.where("school = 'one'").first()["professors"]
    texts = [json.loads(r["value"]) for r in schools.to_json(spark.createDataFrame([("\u00e9", 1)], "name string, n int")).collect()]
    assert texts == [{"name": "\u00e9", "n": 1}]


NODES = {
    "a": [{"id": "1", "legacyId": 11, "firstName": "A", "lastName": "B", "department": None, "avgRating": 4.5, "avgDifficulty": 2.0, "numRatings": 3, "wouldTakeAgainPercent": 80.0, "teacherRatingTags": [{"tagName": "x", "tagCount": 4}]}],
    "b": [{"id": "1", "legacyId": 11, "firstName": "A", "lastName": "B", "department": None, "avgRating": 4.5, "avgDifficulty": 2.0, "numRatings": 3, "wouldTakeAgainPercent": 80.0, "teacherRatingTags": None}, {"id": "2", "legacyId": 12, "firstName": "C", "lastName": "D", "department": "Art", "avgRating": 3.0, "avgDifficulty": 4.0, "numRatings": 0, "wouldTakeAgainPercent": -1.0, "teacherRatingTags": None}],
}
REVIEWS = [{"id": f"r{k}", "class": "M1", "date": "2020-01-01 00:00:00 +0000 UTC", "comment": "clear", "helpfulRating": 5, "clarityRating": 4, "difficultyRating": 2, "ratingTags": "", "wouldTakeAgain": 1, "grade": "A", "isForOnlineClass": False, "isForCredit": True, "attendanceMandatory": "", "thumbsUpTotal": 1, "thumbsDownTotal": 0} for k in range(3)]


class Service(BaseHTTPRequestHandler):
    """Answers like the service: two nodes a page, by search term, name or entity; the first call of each text is refused."""

    refused: set = set()

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        v = body["variables"]
        key = (body["query"], v.get("text") or v.get("id"))
        if key not in self.refused:
            self.refused.add(key)
            self.send_response(500)
            self.end_headers()
            return
        nodes = {"teachers": lambda: NODES.get(v["text"], []), "schools": lambda: [{"id": "s1", "name": v["text"]}, {"id": "s2", "name": "other"}], "reviews": lambda: REVIEWS if v["id"] == "1" else []}[body["query"]]()
        at = int(v["cursor"] or 0)
        page = {"edges": [{"node": n} for n in nodes[at : at + 2]], "pageInfo": {"hasNextPage": at + 2 < len(nodes), "endCursor": str(at + 2)}}
        path = {"teachers": ("search", "teachers"), "schools": ("newSearch", "schools"), "reviews": ("node", "ratings")}[body["query"]]
        text = json.dumps({"data": {path[0]: {path[1]: page}}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(text)

    def log_message(self, *args):
        pass


def test_sources_end_to_end(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    for source in (remote.EntityListing, remote.SchoolSearch, remote.EntityReviews):
        spark.dataSource.register(source)
    read = lambda name, **o: spark.read.format(name).options(url=url, **o).load()
    hit = read("school_search", query="schools", names="North,South").where("place = 0").select("asked", "id").collect()
    assert sorted(map(tuple, hit)) == [("North", "s1"), ("South", "s1")]
    listed = read("entity_listing", query="teachers", terms="a,b,c", school="s1").dropDuplicates(["id"]).persist()
    found = schools.from_listing(schools.parsed(listed.select("node")))
    rows = {r["id"]: r for r in found.collect()}
    assert rows.keys() == {"1", "2"} and rows["1"]["department"] == "Unknown" and rows["2"]["department"] == "Art"
    known = spark.createDataFrame([], "id string, num_ratings int, reviews array<int>")
    asked = [r["id"] for r in merging.to_fetch(found, known).collect()]
    assert asked == ["1"]  # the other has no ratings
    got = read("entity_reviews", query="reviews", ids=",".join(asked), most="2")
    reviews = schools.review_rows(schools.parsed(got.withColumnRenamed("asked", "professor_id"), schools.REVIEW_NODE), "professor_id", "place")
    raw = schools.with_reviews(found, reviews)
    nested = {r["id"]: [x["id"] for x in r["reviews"]] for r in raw.collect()}
    assert nested == {"1": ["r0", "r1"], "2": []}
    document = raw.agg(F.collect_list(F.struct(*raw.columns)).alias("professors")).withColumn("school", F.lit("s"))
    flat = schools.reviews(document).collect()
    assert [(r["entity_id"], r["review_ordinal"], r["clarity"], r["helpful"], r["thumbs_up"]) for r in flat] == [("1", 0, 4.0, 5.0, 1), ("1", 1, 4.0, 5.0, 1)]
    again = {r["id"]: r for r in schools.to_listing(found).collect()}
    assert again["2"]["lastName"] == "D" and again["2"]["numRatings"] == 0
    server.shutdown()


def test_refetch_only_if_nothing_is_new(spark):
    known = spark.createDataFrame([("a", 5, [1]), ("b", 5, []), ("c", 1, [])], "id string, num_ratings int, reviews array<int>")
    some = spark.createDataFrame([("a", 5), ("n", 2)], "id string, num_ratings int")
    assert [r["id"] for r in merging.to_fetch(some, known).collect()] == ["n"]
    assert [r["id"] for r in merging.to_fetch(some.where("id = 'a'"), known).collect()] == ["b"]


def test_lookup_reports_unmatched_slugs(spark):
    catalog_rows = spark.createDataFrame([("x", "X", 150)], "slug string, name string, most int")
    assert [(r["slug"], r["name"], r["known"]) for r in merging.looked_up(catalog_rows, ["y", "x", "y"]).collect()] == [("y", None, False), ("x", "X", True)]


def test_admission_against_a_plain_log(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 2, 3, None]), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(4000))) for i in range(3000)]
    want, logs = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        log = logs[key] = [x for x in logs.get(key, []) if (t - x).total_seconds() < 60]
        want[i] = len(log) < 5
        if want[i]:
            log.append(t)
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    got = {r["event_id"]: r["allowed"] for r in admission.admitted(events, limit=5, window=60.0).collect()}
    assert got == want and len(set(want.values())) == 2
    events.where("user_id IS NOT NULL").orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = admission.admitted_stream(stream, limit=5, window=60.0, late="1 hour").writeStream.format("memory").queryName("admitted_late").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["event_id"]: r["allowed"] for r in spark.table("admitted_late").collect()} == {i: want[i] for i, k, _ in rows if k is not None}
    assert admission.exempt("/") and not admission.exempt("/api/x")


def test_small_labels(spark):
    df = spark.createDataFrame([(76.0, "a. b, c", "x" * 281), (55.0, "a, b. c", "x" * 280), (54.9, "abc", None)], "s double, v string, c string")
    got = [tuple(r) for r in df.select(labels.fit_ring(F.col("s")), labels.short_verdict(F.col("v")), F.length(labels.preview(F.col("c"))), scalars.code_points_head("c", 3)).collect()]
    assert got == [("high", "a", 283, "xxx"), ("medium", "a", 280, "xxx"), ("low", "abc", None, "")]


def test_the_serial_fold_takes_its_texts_from_a_stream(spark):
    """No group of all reviews: what reaches Python is sorted hashes; texts split over batches, schools that share one, and none."""
    rng = random.Random(5)
    rows = [(s, 0, i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))) if i % 7 else None) for s in ("a", "b", None) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "school string, entity_ordinal int, review_ordinal int, comment string")
    trained = topics.train(df)
    plan = trained._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {}
        for r in topics.train(df.coalesce(1)).collect():
            got.setdefault(r["school"], {}).setdefault(r["category"], {})[r["token"]] = r["cnt"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == {"a", "b", None} and topics.train(df.limit(0)).count() == 0
    for s, found in got.items():
        model = PlainModel()
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[2]):
            model.learn(plain_words(r[3]))
        assert found == {c: dict(n) for c, n in model.n.items()}
