"""Registered queries of the extensions: joins in time, event-time windows, frames, levels of totals, sketches, reach.

The reference has none of these; they read the same tables as its own queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stored
from ..operators import levels, reach, sketches, timejoins
from ..sources import documents, testdata
from ..streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


#: The orders dealt over the month of the events, a customer's ten to a user.
ORDERS = """orders_of_users AS (SELECT o_orderkey, CAST(o_custkey // 10 AS BIGINT) AS user_id, o_totalprice,
  TIMESTAMP '2024-01-01' + to_seconds((o_orderkey * 613) % 2592000) AS ts FROM orders)"""


def orders_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, user_id, o_totalprice, ts."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("o_orderkey") * 613 % 2592000)
    return testdata.read(spark, sf_dir, "orders").select("o_orderkey", F.expr("CAST(o_custkey div 10 AS BIGINT)").alias("user_id"), "o_totalprice", at.alias("ts"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, event_type, cents (value as whole cents, so that sums do not depend on their order), props."""
    return testdata.read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"), "props")


CENTS = "CAST(floor(value * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT)"


@query(f"""WITH {ORDERS},
last_of AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
SELECT o.o_orderkey, o.user_id, e.event_id, e.event_type, e.ts AS event_ts
FROM orders_of_users o ASOF LEFT JOIN last_of e ON o.user_id = e.user_id AND o.ts > e.ts""")
def asof_events(spark, sf_dir):
    """Each order with its user's last earlier event."""
    e = events(spark, sf_dir).withColumn("event_ts", F.col("ts"))
    found = timejoins.asof(orders_of_users(spark, sf_dir), e, "user_id", "ts", "ts", {"event_id": "event_id", "event_type": "event_type", "event_ts": "event_ts"}, order=("event_id",), strict=True)
    return found.select("o_orderkey", "user_id", "event_id", "event_type", "event_ts")


@query(f"""WITH {ORDERS},
last_of AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
SELECT o.o_orderkey, CASE WHEN o.ts - e.ts <= INTERVAL 6 HOUR THEN e.event_id END AS event_id
FROM orders_of_users o ASOF LEFT JOIN last_of e ON o.user_id = e.user_id AND o.ts >= e.ts""")
def asof_events_recent(spark, sf_dir):
    """Each order with its user's last event, if that is at most six hours old."""
    found = timejoins.asof(orders_of_users(spark, sf_dir), events(spark, sf_dir), "user_id", "ts", "ts", {"event_id": "event_id"}, order=("event_id",), within=6 * 3600)
    return found.select("o_orderkey", "event_id")


@query(f"""WITH {ORDERS}
SELECT o.o_orderkey, o.user_id, e.event_id FROM orders_of_users o LEFT JOIN events e
ON o.user_id = e.user_id AND e.ts >= o.ts - INTERVAL 1 HOUR AND e.ts <= o.ts + INTERVAL 30 MINUTE""")
def events_around_orders(spark, sf_dir):
    """Each order with its user's events from an hour before to half an hour after; orders without one stay."""
    return timejoins.within_interval(orders_of_users(spark, sf_dir), events(spark, sf_dir), "user_id", "ts", "ts", {"event_id": "event_id"}, 3600, 1800, "left").select("o_orderkey", "user_id", "event_id")


@query("""SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p
ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 12 HOUR""")
def purchases_after_views(spark, sf_dir):
    """Purchases of a user within twelve hours after a view."""
    e = events(spark, sf_dir)
    views, purchases = (e.where(F.col("event_type") == t) for t in ("view", "purchase"))
    return timejoins.within_interval(views, purchases, "user_id", "ts", "ts", {"event_id": "purchase_id"}, 0, 12 * 3600).select(F.col("event_id").alias("view_id"), "purchase_id")


def _sums() -> dict[str, Column]:
    return {"n": F.count(F.lit(1)), "cents": F.sum("cents")}


@query(f"""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, CAST(sum({CENTS}) AS BIGINT) AS cents
FROM events GROUP BY ALL""")
def events_by_day(spark, sf_dir):
    return windows.windowed(events(spark, sf_dir), windows.tumbling("ts", "1 day"), ("event_type",), _sums())


@query(f"""WITH s AS (SELECT date_trunc('hour', ts) - to_hours(k) AS window_start, event_type, {CENTS} AS c FROM events, (SELECT unnest(range(6)) AS k))
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents FROM s GROUP BY ALL""")
def events_by_sliding_hours(spark, sf_dir):
    """Windows of six hours, one each hour."""
    return windows.windowed(events(spark, sf_dir), windows.sliding("ts", "6 hours", "1 hour"), ("event_type",), _sums())


@query(f"""WITH s AS (SELECT user_id, ts, {CENTS} AS c, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
t AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents FROM t GROUP BY user_id, session""")
def user_sessions(spark, sf_dir):
    """A user's session ends six hours after its last event."""
    return windows.windowed(events(spark, sf_dir), windows.session("ts", "6 hours"), ("user_id",), _sums())


@query("""WITH d AS (SELECT l_suppkey AS entity_id, CAST(l_shipdate AS DATE) AS day, count(*) AS n,
  sum((1 + CAST(floor((l_quantity - 1) / 10) AS INT) + 1 + l_partkey % 5) / 2) AS total FROM lineitem GROUP BY ALL),
w AS (SELECT entity_id, day, sum(n) OVER w AS n, sum(total) OVER w AS total FROM d WINDOW w AS (PARTITION BY entity_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW))
SELECT entity_id, day, CAST(n AS BIGINT) AS n, floor(total / n * 100 + 0.5) / 100 AS rating FROM w""")
def rolling_rating(spark, sf_dir):
    """The mean overall rating of an entity's reviews of 30 days, on each day with a review."""
    r = testdata.reviews(spark, sf_dir)
    days = r.groupBy("entity_id", F.to_date("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("clarity") + F.col("helpful")) / 2).alias("total"))
    span = Window.partitionBy("entity_id").orderBy(F.unix_date("day")).rangeBetween(-29, 0)
    rolled = days.select("entity_id", "day", F.sum("n").over(span).alias("n"), F.sum("total").over(span).alias("total"))
    return rolled.select("entity_id", "day", "n", (F.floor(F.col("total") / F.col("n") * 100 + 0.5) / 100).alias("rating"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders)
SELECT o_custkey, o_orderkey, CAST(day - lag(day) OVER t AS BIGINT) AS days_since, CAST(lead(day) OVER t - day AS BIGINT) AS days_until,
       ntile(4) OVER p AS quarter, floor(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) * 10000 + 0.5) / 10000 AS place
FROM o WINDOW t AS (PARTITION BY o_custkey ORDER BY day, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""")
def order_places(spark, sf_dir):
    """Each order among its customer's: days since the one before and until the next, quarter and percent rank by price."""
    o = testdata.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    own = Window.partitionBy("o_custkey")
    by_day, by_price = own.orderBy("day", "o_orderkey"), own.orderBy("o_totalprice", "o_orderkey")
    days = lambda late, early: F.date_diff(late, early).cast("long")
    return o.select(
        "o_custkey",
        "o_orderkey",
        days(F.col("day"), F.lag("day").over(by_day)).alias("days_since"),
        days(F.lead("day").over(by_day), F.col("day")).alias("days_until"),
        F.ntile(4).over(by_price).cast("long").alias("quarter"),
        (F.floor(F.percent_rank().over(own.orderBy("o_totalprice")) * 10000 + 0.5) / 10000).alias("place"),
    )


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
i AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM d)
SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM i GROUP BY user_id, island""")
def activity_streaks(spark, sf_dir):
    """Runs of days on each of which a user was active (gaps and islands)."""
    days = events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return days.withColumn("island", island).groupBy("user_id", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days")).drop("island")


REVIEWED = f"""reviewed AS (SELECT r_name AS region, n_name AS department,
  nullif(([{', '.join(repr(g) for g in testdata.GRADES)}])[CAST(1 + l_orderkey % {len(testdata.GRADES)} AS INT)], 'Not sure yet') AS grade, l_linenumber AS votes
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LEVEL = "CAST(count(*) AS BIGINT) AS n, CAST(sum(votes) AS BIGINT) AS votes"


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, department, grade (null if not sure yet), votes of each review."""
    read = lambda name: testdata.read(spark, sf_dir, name)
    where = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = where.select(F.col("s_suppkey").alias("entity_id"), F.col("r_name").alias("region"), F.col("n_name").alias("department"))
    r = testdata.reviews(spark, sf_dir).select("entity_id", F.nullif("grade", F.lit("Not sure yet")).alias("grade"), F.col("thumbs_up").alias("votes"))
    return r.join(named, "entity_id").drop("entity_id")


def _votes() -> dict[str, Column]:
    return {"n": F.count(F.lit(1)), "votes": F.sum("votes").cast("long")}


@query(f"""WITH {REVIEWED} SELECT region, department, grade, CAST(grouping_id(region, department, grade) AS BIGINT) AS level, {LEVEL}
FROM reviewed GROUP BY CUBE (region, department, grade)""")
def review_cube(spark, sf_dir):
    """Counts at every combination of region, department and grade; `level` tells a total from a grade that is null."""
    return levels.cube(_reviewed(spark, sf_dir), ("region", "department", "grade"), _votes())


@query(f"""WITH {REVIEWED} SELECT region, department, grade, CAST(grouping_id(region, department, grade) AS BIGINT) AS level, {LEVEL}
FROM reviewed GROUP BY ROLLUP (region, department, grade)""")
def review_rollup(spark, sf_dir):
    return levels.rollup(_reviewed(spark, sf_dir), ("region", "department", "grade"), _votes())


@query(f"""WITH {REVIEWED} SELECT region, department, grade, CAST(grouping_id(region, department, grade) AS BIGINT) AS level, {LEVEL}
FROM reviewed GROUP BY GROUPING SETS ((region, grade), (department), ())""")
def review_sets(spark, sf_dir):
    return levels.grouping_sets(_reviewed(spark, sf_dir), ("region", "department", "grade"), (("region", "grade"), ("department",), ()), _votes())


@query(f"""SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, true AS users_within, true AS quantiles_within FROM events GROUP BY event_type""")
def sketch_errors(spark, sf_dir):
    """Daily sketches of users and values, merged by event type, beside exact numbers: are they within the stated bounds?"""
    e = events(spark, sf_dir)
    daily = sketches.daily(e, "ts", ("event_type",), "user_id", "cents")
    merged = sketches.merged(daily, ("event_type",))
    return sketches.compared(e, merged, ("event_type",), "user_id", "cents")


@query(f"""WITH e AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
edges AS (SELECT 'c' || c AS a, 's' || s AS b FROM e UNION ALL SELECT 's' || s, 'c' || c FROM e)
SELECT node, CAST(min(steps) AS BIGINT) AS steps FROM (
  WITH RECURSIVE r(node, steps) AS (SELECT 'c7', 0 UNION SELECT b, steps + 1 FROM r JOIN edges ON a = node WHERE steps < {reach.STEPS}) SELECT * FROM r) GROUP BY node""")
def buyers_reach(spark, sf_dir):
    """Who is reached from one buyer over shared suppliers, and in how many steps."""
    bought = testdata.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(testdata.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    # numbers, buyers even and suppliers odd, joined and stored once: each step reads them again; steps need no distinct edges
    pairs = stored.saved(bought.select((F.col("o_custkey").cast("long") * 2).alias("buyer"), (F.col("l_suppkey").cast("long") * 2 + 1).alias("supplier")))
    edges = pairs.select(F.col("buyer").alias("a"), F.col("supplier").alias("b")).unionByName(pairs.select(F.col("supplier").alias("a"), F.col("buyer").alias("b")))
    found = reach.reached(edges, spark.range(1).select(F.lit(2 * 7).cast("long").alias("node")))
    kind = F.when(F.col("node") % 2 == 0, "c").otherwise("s")
    return found.select(F.concat(kind, F.shiftright("node", 1)).alias("node"), "steps")


@query("""SELECT event_type, '$.' || key AS path, 'BIGINT' AS kind, count(*) AS n, min(CAST(json_extract_string(props, '$.' || key) AS BIGINT)) AS least, max(CAST(json_extract_string(props, '$.' || key) AS BIGINT)) AS most
FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL""")
def event_fields(spark, sf_dir):
    """The fields that events' properties turn out to have, by path, with how many hold a number and which ones."""
    e = events(spark, sf_dir).select("event_id", "event_type", documents.parsed("props").alias("doc"))
    found = documents.fields(e, "doc", ("event_type",))
    return found.groupBy("event_type", "path", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("text").cast("long")).alias("least"), F.max(F.col("text").cast("long")).alias("most"))
