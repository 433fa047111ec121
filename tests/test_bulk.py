"""A bulk run against a stand-in for the service: selection, paging, limits, merging, analysis, outcomes."""

from __future__ import annotations

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tarnwell.operators import merging
from tarnwell.plans import bulk
from tarnwell.sources import remote
from tarnwell.sources.keyed import KeyedTable

CATALOG = "slug string, name string, school_id string, most int"


def teacher(school, i, ratings=3):
    return {"id": f"{school}-{i}", "legacyId": i, "firstName": f"F{i}", "lastName": "L", "department": "Art", "avgRating": 4, "avgDifficulty": 2, "numRatings": ratings, "wouldTakeAgainPercent": -1, "teacherRatingTags": [], "odd": {"kept": 1}}


def review(of, i):
    return {"id": f"{of}/{i}", "class": "A 1", "date": "2024-01-0%d 00:00:00 +0000 UTC" % (i + 1), "comment": "the exam and the grading were fair, helpful office hours", "helpfulRating": 5, "clarityRating": 4, "difficultyRating": 2, "ratingTags": "a--b", "wouldTakeAgain": 1, "grade": "A", "thumbsUpTotal": 1, "thumbsDownTotal": 0}


class Stub(BaseHTTPRequestHandler):
    teachers: dict = {}
    reviews: dict = {}
    asked: Counter = Counter()

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        v, kind = body["variables"], body["query"]
        Stub.asked[kind, v.get("id") or v["text"]] += 1
        nodes = {"s": lambda: [{"id": f"id-{v['text']}"}, {"id": "other"}], "t": lambda: [t for t in Stub.teachers.get(v["schoolID"], []) if t["firstName"].lower().startswith(v["text"])], "r": lambda: Stub.reviews.get(v["id"], [])}[kind]()
        at = int(v["cursor"] or 0)
        outer, inner = {"s": ("newSearch", "schools"), "t": ("search", "teachers"), "r": ("node", "ratings")}[kind]
        page = {"edges": [{"node": n} for n in nodes[at : at + 2]], "pageInfo": {"hasNextPage": at + 2 < len(nodes), "endCursor": str(at + 2)}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"data": {outer: {inner: page}}}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Stub.teachers = {"id-North": [teacher("n", i) for i in range(5)] + [teacher("n", 9, 0)], "south": [teacher("s", 1), teacher("s", 2)], "east": []}
    Stub.reviews = {f"n-{i}": [review(f"n-{i}", k) for k in range(3)] for i in range(5)} | {"s-1": [review("s-1", 0)]}
    Stub.asked = Counter()
    yield bulk.Service(f"http://127.0.0.1:{server.server_port}/", "s", "t", "r", tasks=2, terms=("f", "f1"))
    server.shutdown()


def outcome(df):
    return {r["slug"]: (r["status"], r["professors"], r["reviews"]) for r in df.collect()}


def test_bulk_runs(spark, tmp_path, service):
    catalog = spark.createDataFrame([("north", "North", None, 3), ("south", "South", "south", 150), ("east", "East", "east", 150)], CATALOG)
    root = str(tmp_path / "root")
    run = lambda **kw: bulk.bulk_run(spark, catalog, root, service, "2025-01-01 00:00:00", **kw)
    first = run()
    assert outcome(first) == {"north": ("Ready", 3, 9), "south": ("Ready", 2, 1), "east": ("Error", None, None)}
    assert tuple(merging.run_counters(first).first()) == (2, 1, 0)
    assert Stub.asked["r", "n-0"] == 2 and Stub.asked["r", "n-4"] == 0  # two pages, once; the fourth and fifth are beyond the limit
    analyzed = {r["entity_id"]: r for r in spark.read.parquet(f"{root}/analyzed").collect()}
    assert analyzed["n-1"]["school"] == "north" and analyzed["n-1"]["grade_distribution"][0]["n"] == 3 and analyzed["s-2"]["n_overall"] == 0
    # missing: only the school without a file is asked for again
    before = Counter(Stub.asked)
    assert outcome(run()) == {"east": ("Error", None, None)} and Stub.asked["r", "n-0"] == before["r", "n-0"]
    # refresh: what has gained reviews is fetched where a school has nothing new; others stay
    Stub.reviews["s-2"] = [review("s-2", 0), review("s-2", 1)]
    assert outcome(run(mode="refresh")) == {"north": ("Ready", 3, 9), "south": ("Ready", 2, 3)}
    assert Stub.asked["r", "n-0"] == before["r", "n-0"] and Stub.asked["r", "s-1"] == before["r", "s-1"]
    Stub.teachers["south"].append(teacher("s", 3))
    assert outcome(run(slugs=["south", "unheard"])) == {"south": ("Ready", 3, 3)}
    assert KeyedTable(spark, f"{root}/raw").read().count() == 6
    assert outcome(bulk.analyzed_files(spark, root).selectExpr("slug", "'Ready' AS status", "professors", "reviews")) == {"north": ("Ready", 3, 9), "south": ("Ready", 3, 3)}


def test_waits_are_options():
    waits = []
    answers = iter([(429, {}), (500, {}), (200, {"data": {"a": {"edges": [{"node": {"id": 1}}], "pageInfo": {"hasNextPage": True, "endCursor": "x"}}}}), (200, {"data": {"a": {"edges": [{"node": {"id": 2}}]}}})])
    got = list(remote.pages(lambda body: next(answers), "q", {}, ("a",), sleep=waits.append, extra=2, pace=0.3))
    assert [n["id"] for n in got] == [1, 2] and waits == [3, 2, 0.3]
    r = remote.EntityReviews({"url": "u", "query": "q", "ids": "1", "limited_wait": "2", "pace": "0.25"}).reader(None)
    assert (r.extra, r.pace) == (2, 0.25)
