"""Variants and SQL functions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tarnwell.operators.posterior import posterior
from tarnwell.functions import labels
from tarnwell.plans import surface
from tarnwell.sources import documents, testdata

NODES = [
    {"id": "a", "name": "A", "extra": {"deep": {"list": [1, {"x": None}, "t"]}, "n": 1.5}, "tags": []},
    {"id": "b", "other": True, "big": 12345678901234, "text": "é \"q\"", "empty": {}},
    {"id": "c", "extra": {"deep": 3}},
]


def test_unknown_fields_survive_and_are_found_by_path(spark):
    texts = [(i, json.dumps(n)) for i, n in enumerate(NODES)] + [(8, None), (9, "{broken")]
    df = spark.createDataFrame(texts, "k int, text string").select("k", documents.parsed("text").alias("doc"))
    back = {r["k"]: r["t"] and json.loads(r["t"]) for r in df.select("k", documents.round_trip("doc").alias("t")).collect()}
    assert back == dict(enumerate(NODES)) | {8: None, 9: None}
    wide = documents.shredded(df, "doc", {"id": ("$.id", "string"), "n": ("$.extra.n", "double"), "item": ("$.extra.deep.list[2]", "string"), "big": ("$.big", "long"), "odd": ("$.name", "int")})
    assert [tuple(r)[2:] for r in wide.orderBy("k").collect()] == [("a", 1.5, "t", None, None), ("b", None, None, 12345678901234, None), ("c", None, None, None, None)] + [(None,) * 5] * 2
    found = {(r["k"], r["path"]): (r["kind"], r["text"]) for r in documents.fields(df, "doc", ("k",), depth=6).collect()}
    assert found[0, "$.extra.deep.list[2]"] == ("STRING", "t") and found[0, "$.extra.n"][1] == "1.5" and found[1, "$.other"] == ("BOOLEAN", "true") and found[1, "$.text"][1] == 'é "q"'
    assert found[0, "$.extra.deep.list[1].x"][0] == "VOID" and found[2, "$.extra.deep"] == ("BIGINT", "3")
    assert {p for k, p in found if k == 0} >= {"$.id", "$.name", "$.extra.deep.list[0]"} and not {k for k, _ in found} & {8, 9}
    shallow = {r["path"]: r["text"] for r in documents.fields(df.where("k = 0"), "doc", ("k",), depth=1).collect()}
    assert json.loads(shallow["$.extra"]) == NODES[0]["extra"] and shallow["$.name"] == "A"
    assert documents.fields(df.limit(0), "doc", ("k",)).count() == 0


def test_functions_of_sql_equal_the_library(spark, sf_dir):
    surface.views(spark, sf_dir)
    names = surface.register(spark)
    assert {"posterior_mean", "letter_grade", "rating_counts", "last_events", "admitted"} <= set(names)
    counts = spark.sql("SELECT entity_id, posterior_mean(n_above, n) AS mean, letter_grade(posterior_mean(n_above, n)) AS letter FROM rating_counts() ORDER BY entity_id")
    from tarnwell.operators.posterior import rating_counts

    own = rating_counts(testdata.reviews(spark, sf_dir)).select("entity_id", posterior(F.col("n_good"), F.col("n_overall"), 3.5)["mean"].alias("mean")).select("entity_id", "mean", labels.letter_grade(F.col("mean")).alias("letter")).orderBy("entity_id")
    assert counts.collect() == own.collect()
    one = spark.sql("SELECT entity_id, clarity, helpful, date FROM reviews_of(7)")
    same = testdata.reviews(spark, sf_dir).where("entity_id = 7").select("entity_id", "clarity", "helpful", "date")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, same.collect())) and one.count()
    last = spark.sql("SELECT * FROM last_events('view')")
    e = testdata.read(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, e.collect()))


def test_functions_of_sql_are_part_of_the_plan(spark, sf_dir):
    """A call is inlined: filters reach the scan, columns are pruned, and there is no Python."""
    surface.views(spark, sf_dir)
    surface.register(spark)
    plan = spark.sql("SELECT posterior_mean(count_if(clarity >= 3), count(*)) AS p FROM reviews_of(7)")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_suppkey,7)" in plan and "l_partkey" not in plan.split("ReadSchema")[1].split(">")[0] and "Python" not in plan
    with_sql = spark.sql("SELECT * FROM last_events('view') WHERE user_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,3)" in with_sql and "EqualTo(event_type,view)" in with_sql


def test_admission_from_sql(spark, sf_dir):
    surface.views(spark, sf_dir)
    surface.register(spark)
    got = spark.sql("""SELECT k, id, allowed FROM admitted(TABLE(SELECT user_id AS k, event_id AS id, unix_micros(CAST(ts AS TIMESTAMP)) / 1e6D AS at FROM events)
        PARTITION BY k ORDER BY (at, id), 3, 86400D)""")
    from tarnwell.streaming.admission import admitted

    want = admitted(testdata.read(spark, sf_dir, "events"), limit=3, window=86400.0).select("user_id", "event_id", "allowed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
