"""The keyed table: versions, what a merge rewrites, what readers see and skip."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tarnwell.sources import keyed
from tarnwell.streaming import ingest

SCHEMA = "id string, name string, n int"


def latest(old, new):
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def rows(df):
    return {r["id"]: (r["name"], r["n"]) for r in df.collect()}


def parts(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{folder}/data") for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path / "t"))
    t.create(spark.createDataFrame([(f"k{i}", "first", i) for i in range(400)], SCHEMA), "id", 16)
    return t


def test_merge_rewrites_touched_files_only(spark, table, tmp_path):
    before, first = parts(tmp_path / "t"), table.manifest()
    assert len(first.files) == 16 and sum(f.rows for f in first.files) == 400
    batch = spark.createDataFrame([("k7", "second", 70), ("new", "second", 1)], SCHEMA)
    m = table.merge(batch, latest)
    touched = {r[0] for r in batch.select(keyed._bucket(F.col("id"), 16)).collect()}
    assert m.version == 2 and m.written == len(touched) <= 2
    assert {f.path for f in m.files} & {f.path for f in first.files} == {f.path for f in first.files if f.bucket not in touched}
    after = parts(tmp_path / "t")
    assert {p: t for p, t in after.items() if p in before} == before and len(after) - len(before) == len(touched)
    want = {f"k{i}": ("first", i) for i in range(400)} | {"k7": ("second", 70), "new": ("second", 1)}
    assert rows(table.read()) == want and rows(table.read(1)) == {f"k{i}": ("first", i) for i in range(400)}


def test_readers_keep_their_version(spark, table):
    """A reader that began before a commit goes on with its version; what a writer leaves unfinished is never read."""
    began = table.read()
    table.merge(spark.createDataFrame([("k1", "second", 0)], SCHEMA), latest)
    assert rows(began)["k1"] == ("first", 1) and rows(table.read())["k1"] == ("second", 0)
    table._write(spark.createDataFrame([("k1", "lost", 0)], SCHEMA), "id", 16)  # a writer that dies before its commit
    assert rows(table.read())["k1"] == ("second", 0) and table.versions() == [1, 2]


def test_one_writer_wins(spark, table):
    """A merge that finds its version taken is made again on the version that took it."""
    other = keyed.KeyedTable(spark, table.path)
    calls = []

    def slow(old, new):
        if not calls:
            other.merge(spark.createDataFrame([("k1", "other", 5), ("k2", "other", 6)], SCHEMA), latest)
        calls.append(1)
        return latest(old, new)

    m = table.merge(spark.createDataFrame([("k1", "mine", 9)], SCHEMA), slow)
    assert m.version == 3 and len(calls) == 2
    assert rows(table.read())["k1"] == ("mine", 9) and rows(table.read())["k2"] == ("other", 6)
    with pytest.raises(keyed.Conflict):
        table._commit(m)


def test_anti_join_skips_files(spark, table):
    found = spark.createDataFrame([(f"x{i}", "f", i) for i in range(30)] + [("k3", "f", 0), (None, "f", 0)], SCHEMA)
    fresh, read = table.unknown(found)
    assert sorted(r["id"] or "" for r in fresh.collect()) == sorted(["", *(f"x{i}" for i in range(30))])
    assert read == 1  # the file of k3; largest and least keys and filters rule the others out
    low = spark.createDataFrame([("a", "f", 0), ("z", "f", 0)], SCHEMA)
    fresh, read = table.unknown(low)
    assert read == 0 and fresh.count() == 2
    got, read = table.lookup(spark.createDataFrame([("k3",), ("k3",), ("x1",)], "id string"))
    assert rows(got) == {"k3": ("first", 3)} and read == 1


def test_filters_never_miss(spark, table):
    told = {r["id"]: r["_maybe"] for r in table._likely(table.read().select("id"), table.manifest()).collect()}
    assert len(told) == 400 and all(told.values())
    no = table._likely(spark.range(2000).select(F.concat(F.lit("k1x"), "id").alias("id")), table.manifest()).where("_maybe").count()
    assert no < 20


def test_a_numbered_batch_runs_again(spark, table):
    batch = spark.createDataFrame([("k1", "s", 1)], SCHEMA)
    add = lambda old, new: old.join(new.select("id", F.col("n").alias("m")), "id", "left").select("id", "name", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
    for _ in range(2):
        assert table.merge(batch, add, 2).version == 2 and table.versions() == [1, 2] and rows(table.read())["k1"][1] == 2
    assert table.merge(batch, add, 3).version == 3 and rows(table.read())["k1"][1] == 3 and rows(table.read(2))["k1"][1] == 2
    assert table.merge(batch.limit(0), add).written == 0 and rows(table.read())["k1"][1] == 3


def test_other_buckets_and_cleaning(spark, table, tmp_path):
    want = rows(table.read())
    assert len(table.dealt_anew(3).files) == 3 and rows(table.read()) == want
    table.merge(spark.createDataFrame([("k1", "b", 1)], SCHEMA), latest)
    used = {f.path for v in table.versions()[-1:] for f in table.manifest(v).files}
    assert table.cleaned(1) > 0 and table.versions() == [3]
    assert {os.path.relpath(os.path.dirname(p), tmp_path / "t") for p in parts(tmp_path / "t")} == used
    assert rows(table.read()) == want | {"k1": ("b", 1)}
    with pytest.raises(ValueError):
        table.manifest(1)


def test_empty_and_odd_tables(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        t.read()
    assert t.unknown(spark.createDataFrame([("a", "b", 1)], SCHEMA))[1] == 0
    t.create(spark.createDataFrame([], SCHEMA), "id", 4)
    assert t.read().count() == 0
    assert rows(t.merge(spark.createDataFrame([("a", None, None)], SCHEMA), latest) and t.read()) == {"a": (None, None)}
    numbers = keyed.KeyedTable(spark, str(tmp_path / "numbers"))
    numbers.create(spark.range(100).withColumn("x", F.lit("v")), "id", 8)
    assert numbers.unknown(spark.range(95, 105))[0].count() == 5


def test_ingest_merges_by_bucket(spark, tmp_path):
    schema = "id string, name string, reviews array<int>"
    target = str(tmp_path / "t")
    ingest.merge_batch(spark.createDataFrame([(f"e{i}", "n", [1]) for i in range(500)], schema), target, 1)
    m = ingest.merge_batch(spark.createDataFrame([("e3", "better", [1, 2]), ("e4", "empty", [])], schema), target, 2)
    assert 1 <= m.written <= 2 and len(m.files) > 50
    got = {r["id"]: (r["name"], r["ordinal"]) for r in ingest.current(spark, target).collect()}
    first = {r["id"]: r["ordinal"] for r in keyed.KeyedTable(spark, target).read(1).collect()}
    assert got["e3"] == ("better", first["e3"]) and got["e4"] == ("n", first["e4"]) and len(got) == 500
