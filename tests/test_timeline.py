"""Joins in time, event-time windows of tables and streams, levels of totals, sketches and reach, against plain versions."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnwell.operators import levels, reach, sketches, timejoins
from tarnwell.plans import timeline
from tarnwell.streaming import windows

T0 = dt.datetime(2024, 1, 1)
LEFT = "id long, who string, at timestamp, k int"
RIGHT = "eid long, who string, at timestamp, what string"


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def sides(seed=1, n=150):
    """A third of all rows is one key's; null keys and times, ties and repeated rows are among them, and times before 1970."""
    rng = random.Random(seed)
    who = lambda: rng.choice(["hot", "hot", "a", "b", "c", None])
    when = lambda: rng.choice([None, *(rng.randrange(-300, 4000) for _ in range(20)), -10**10, -(10**10) + 5])
    left = [(i, who(), at(when()), i) for i in range(n)]
    right = [(i, who(), at(when()), f"x{i % 7}") for i in range(n)]
    return left + left[:20], right + right[:20]


def asof_brute(left, right, strict=False, within=None):
    out = []
    for i, who, t, k in left:
        fit = [r for r in right if who is not None and t is not None and r[1] == who and r[2] is not None and (r[2] < t if strict else r[2] <= t)]
        best = max(fit, key=lambda r: (r[2], r[0]), default=None)
        if best and within is not None and (t - best[2]).total_seconds() > within:
            best = None
        out.append((i, who, t, k, best[0] if best else None, best[3] if best else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("strict,within,stretch", [(False, None, 86400), (True, None, 60), (False, 30, 7), (True, 200, 1000)])
def test_asof_matches_brute_force(spark, strict, within, stretch):
    left, right = sides()
    found = timejoins.asof(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "who", "at", "at", {"eid": "eid", "what": "what"}, order=("eid",), strict=strict, within=within, stretch=stretch)
    assert found.columns == ["id", "who", "at", "k", "eid", "what"] and got(found) == asof_brute(left, right, strict, within)


def test_asof_of_empty_sides(spark):
    left, right = sides()
    no_left, no_right = spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT)
    join = lambda a, b: timejoins.asof(a, b, "who", "at", "at", {"eid": "eid"})
    assert join(no_left, spark.createDataFrame(right, RIGHT)).count() == 0
    assert [r["eid"] for r in join(spark.createDataFrame(left, LEFT), no_right).collect()] == [None] * len(left)


def test_asof_splits_a_hot_key(spark):
    """One key has all rows, over ten days; no group that is sorted holds more than a day of them, but for a carried row."""
    day = 86400
    left = [(i, "hot", at(i * 997 % (10 * day)), i) for i in range(800)]
    right = [(i, "hot", at(i * 1009 % (10 * day)), "x") for i in range(800)]
    found = timejoins.asof(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "who", "at", "at", {"eid": "eid", "what": "what"}, order=("eid",))
    assert got(found) == asof_brute(left, right)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    sorted_by = [line for line in plan.splitlines() if "Window [last(found" in line]
    assert sorted_by and all(", [k#" in line and ", b#" in line.split(", [k#")[1].split("]")[0] for line in sorted_by)  # by key and stretch


def interval_brute(left, right, before, after, how):
    out = []
    for i, who, t, _ in left:
        fit = [r[0] for r in right if who is not None and t is not None and r[1] == who and r[2] is not None and -before <= (r[2] - t).total_seconds() <= after]
        out += [(i, e) for e in fit] or ([(i, None)] if how == "left" else [])
    return sorted(out, key=str)


@pytest.mark.parametrize("before,after", [(60, 0), (0, 0), (10, 25), (-5, 90), (100000, 100000)])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_intervals_match_brute_force(spark, before, after, how):
    left, right = sides(2, 90)
    found = timejoins.within_interval(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "who", "at", "at", {"eid": "eid"}, before, after, how)
    assert got(found.select("id", "eid")) == interval_brute(left, right, before, after, how)


def test_joins_in_time_make_no_products(spark, sf_dir):
    for name in ("asof_events", "events_around_orders", "purchases_after_views"):
        df = timeline.QUERIES[name](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_interval_parameters(spark):
    left, right = spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT)
    for bad in ({"how": "full", "before": 1, "after": 1}, {"how": "inner", "before": -5, "after": 4}):
        with pytest.raises(ValueError):
            timejoins.within_interval(left, right, "who", "at", "at", {"eid": "eid"}, **bad)


# streams

EVENTS = "event_id long, ts timestamp, user_id long, cents long"


class Feed:
    """Files that a stream reads one by one, each as a batch of its own."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0

    def put(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/part={self.n:04d}")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/*").drop("part")


def drained(stream, name, tmp_path, mode="append"):
    """The stream's rows and its progress, batch by batch."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"state-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return got(stream.sparkSession.table(name)), q


def some_events(seed, n=240, days=2):
    rng = random.Random(seed)
    times = sorted(rng.randrange(days * 86400) for _ in range(n))
    return [(i, at(t), rng.choice([1, 1, 2, 3]), rng.randrange(100)) for i, t in enumerate(times)]


KINDS = {"tumbling": lambda ts: windows.tumbling(ts, "1 hour"), "sliding": lambda ts: windows.sliding(ts, "2 hours", "30 minutes"), "session": lambda ts: windows.session(ts, "20 minutes")}


def sums():
    return {"n": F.count(F.lit(1)), "cents": F.sum("cents")}


def windows_brute(rows, kind):
    out = defaultdict(lambda: [0, 0])
    if kind == "session":
        by = defaultdict(list)
        for r in rows:
            by[r[2]].append(r)
        for user, own in by.items():
            first = last = None
            for r in sorted(own, key=lambda r: r[1]):
                if last is None or r[1] - last > dt.timedelta(minutes=20):
                    first, held = r[1], []
                last = r[1]
                held.append(r)
                out[first, user] = [len(held), sum(x[3] for x in held), last + dt.timedelta(minutes=20)]
        return sorted(((s, v[2], u, v[0], v[1]) for (s, u), v in out.items()), key=str)
    length, step = (3600, 3600) if kind == "tumbling" else (7200, 1800)
    for _, t, user, cents in rows:
        s = (t - T0).total_seconds() // step * step
        while s > (t - T0).total_seconds() - length:
            out[at(s), user][0] += 1
            out[at(s), user][1] += cents
            s -= step
    return sorted(((s, s + dt.timedelta(seconds=length), u, *v) for (s, u), v in out.items()), key=str)


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_windows_of_streams_equal_those_of_tables(spark, tmp_path, kind):
    rows = some_events(3)
    end = (10**6, at(10 * 86400), 9, 0)  # closes all windows before it
    feed = Feed(spark, tmp_path / "in", EVENTS)
    for k in range(0, len(rows), 60):
        batch = rows[k : k + 60]
        random.Random(k).shuffle(batch)
        feed.put([*batch, batch[0]])  # a row that comes twice counts once
    feed.put([end])
    whole = windows.windowed(spark.createDataFrame([*rows, (5, None, 1, 7)], EVENTS), KINDS[kind]("ts"), ("user_id",), sums())
    want = windows_brute(rows, kind)
    assert got(whole) == want
    found, _ = drained(windows.windowed_stream(feed.stream(), KINDS[kind], "ts", "3 hours", "event_id", ("user_id",), sums()), f"w_{kind}", tmp_path)
    assert found == want


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", EVENTS)
    feed.put([(1, at(0), 1, 1), (2, at(7200), 1, 10)])  # the watermark comes to 7200 - 600
    feed.put([(8, at(7210), 3, 5)])  # the batch after this one goes by that
    late = [(3, at(60), 1, 100), (4, at(6599), 1, 100), (5, at(100), 2, 100)]
    on_time = [(6, at(6700), 1, 1000)]
    feed.put(late + on_time)
    feed.put([(7, at(86400), 9, 0)])
    listener = windows.LateRows()
    spark.streams.addListener(listener)
    try:
        found, q = drained(windows.windowed_stream(feed.stream(), KINDS["tumbling"], "ts", "10 minutes", "event_id", ("user_id",), sums()), "w_late", tmp_path)
    finally:
        spark.streams.removeListener(listener)
    kept = [(1, at(0), 1, 1), (2, at(7200), 1, 10), (8, at(7210), 3, 5), *on_time]
    assert found == windows_brute(kept, "tumbling")
    assert sum(windows.late_rows(p) for p in q.recentProgress) == len(late)
    assert listener.dropped[str(q.id)] == len(late)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_of_streams_equal_those_of_tables(spark, tmp_path, how):
    """Both orders of arrival, partners in other batches, rows without a partner; the state is empty at the end."""
    rng = random.Random(11)
    times = sorted(rng.randrange(20000) for _ in range(120))
    left = [(i, rng.choice("ab"), at(t), i) for i, t in enumerate(times)]
    right = [(1000 + i, rng.choice("abc"), at(t + rng.randrange(-40, 40)), "x") for i, t in enumerate(times)]
    one, two = Feed(spark, tmp_path / "l", LEFT), Feed(spark, tmp_path / "r", RIGHT)
    for k in range(0, 120, 40):
        one.put(left[k : k + 40])
        two.put(right[k : k + 40])
    for feed, row in ((one, (9000, "z", at(10**6), 0)), (two, (9001, "y", at(10**6), ""))):
        feed.put([row])
        feed.put([(row[0] + 10, row[1], at(2 * 10**6), row[3])])
    stream = windows.within_interval_stream(one.stream(), two.stream(), "who", "at", "at", {"eid": "eid"}, 30, 45, "2 hours", how)
    found, q = drained(stream.select("id", "eid"), f"j_{how}", tmp_path)
    table = timejoins.within_interval(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "who", "at", "at", {"eid": "eid"}, 30, 45, how)
    want = got(table.select("id", "eid"))
    assert [r for r in found if r[0] < 9000] == want == interval_brute(left, right, 30, 45, how)
    assert any(r[1] is None for r in want) == (how == "left") and windows.rows_held(q) <= 4  # the closing rows alone


# levels, sketches, reach


def test_levels_tell_null_keys_from_totals(spark):
    rows = [("x", "g", 1), ("x", None, 2), (None, "g", 4), (None, None, 8)]
    df = spark.createDataFrame(rows, "a string, b string, v int")
    sums = {"v": F.sum("v")}
    found = {(r["a"], r["b"], r["level"]): r["v"] for r in levels.cube(df, ("a", "b"), sums).collect()}
    assert found == {("x", "g", 0): 1, ("x", None, 0): 2, (None, "g", 0): 4, (None, None, 0): 8, ("x", None, 1): 3, (None, None, 1): 12, (None, "g", 2): 5, (None, None, 2): 10, (None, None, 3): 15}
    assert {k: v for k, v in found.items() if k[2] != 2} == {(r["a"], r["b"], r["level"]): r["v"] for r in levels.rollup(df, ("a", "b"), sums).collect()}
    sets = levels.grouping_sets(df, ("a", "b"), (("b",), ()), sums)
    assert {(r["a"], r["b"], r["level"]): r["v"] for r in sets.collect()} == {k: v for k, v in found.items() if k[2] in (2, 3)}
    assert levels.cube(df.limit(0), ("a", "b"), sums).where("level < 3").count() == 0
    with pytest.raises(ValueError):
        levels.grouping_sets(df, ("a", "b"), (("c",),), sums)


def test_a_cube_scans_once(spark, sf_dir):
    plan = timeline.review_cube(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1 and plan.count("Expand") == 1


def test_sketches_of_days_are_those_of_all(spark):
    rng = random.Random(2)
    rows = [(i, at(rng.randrange(20 * 86400)), rng.randrange(5000), rng.choice([None, rng.randrange(10**6)])) for i in range(20000)]
    df = spark.createDataFrame(rows, EVENTS).withColumn("g", F.lit("all"))
    daily = sketches.daily(df, "ts", ("g",), "user_id", "cents")
    assert daily.count() == 20
    whole = sketches.merged(daily, ("g",))
    r = whole.select("n", sketches.distinct_count().alias("d"), *(sketches.quantile(q).alias(f"q{q}") for q in sketches.QUANTILES)).first()
    exact = len({x[2] for x in rows})
    assert r["n"] == 20000 and abs(r["d"] - exact) < exact * sketches.SIGMAS * 1.04 / 64
    values = sorted(x[3] for x in rows if x[3] is not None)
    for q in sketches.QUANTILES:
        assert abs(sum(v <= r[f"q{q}"] for v in values) / len(values) - q) < sketches.RANK_ERROR + 1e-3
    # one day more: the stored sketches and the new one, no row read again
    old, new = daily.where("day < '2024-01-20'"), daily.where("day >= '2024-01-20'")
    both = sketches.merged(old.unionByName(new), ("g",)).select(sketches.distinct_count().alias("d")).first()["d"]
    assert both == r["d"]
    assert tuple(sketches.compared(df, whole, ("g",), "user_id", "cents").first())[3:] == (True, True)


def test_reach_ends_in_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y"), (None, "b"), ("b", None), ("a", "b")]
    df = spark.createDataFrame(edges, "a string, b string")
    start = spark.createDataFrame([("a",), ("a",), (None,)], "node string")
    found = lambda steps: dict(tuple(r) for r in reach.reached(df, start, steps).collect())
    assert found(0) == {"a": 0} and found(2) == {"a": 0, "b": 1, "c": 2} and found(50) == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert reach.reached(df, start.limit(0), 3).count() == 0


@pytest.mark.parametrize("name", sorted(timeline.SQL))
def test_sql_of_the_extensions(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("orders", "events", "lineitem", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = timeline.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({timeline.SQL[name]})").fetchall()
    assert Counter(map(str, want)) == Counter(str(tuple(r)) for r in df.select(*columns).collect()) and want


def test_reach_joins_its_edges_once(spark, sf_dir, monkeypatch):
    plans, real = [], reach.reached
    monkeypatch.setattr(reach, "reached", lambda edges, starts: (plans.append(edges._jdf.queryExecution().optimizedPlan().toString()), real(edges, starts))[1])
    got = timeline.buyers_reach(spark, sf_dir)
    assert "Join" not in plans[0] and "Relation [buyer" in plans[0] and got.where("steps = 0").first()["node"] == "c7"
