"""The library from SQL: views of the tables, and operators as functions of spark.sql.

Scalar operators become SQL functions and table operators SQL table functions whose bodies are SQL, so a call is inlined
into the caller's plan: the same scans, filters pushed down, no Python. What SQL cannot say natively is a Python table
function over rows that the caller partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.posterior import THRESHOLDS
from ..streaming.admission import admit

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def views(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> None:
    """A temporary view for each table."""
    for name in tables:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


#: name -> definition after CREATE OR REPLACE TEMPORARY FUNCTION.
FUNCTIONS: dict[str, str] = {
    "rounded": "rounded(x DOUBLE, digits INT) RETURNS DOUBLE RETURN floor(x * power(10D, digits) + 0.5D) / power(10D, digits)",
    # the prior is Beta(2, 2)
    "posterior_mean": "posterior_mean(successes BIGINT, n BIGINT) RETURNS DOUBLE RETURN floor((successes + 2D) / (n + 4D) * 10000D + 0.5D) / 10000D",
    "letter_grade": """letter_grade(good DOUBLE) RETURNS STRING RETURN CASE WHEN good IS NULL THEN '?' WHEN good >= 0.9 THEN 'A+' WHEN good >= 0.8 THEN 'A'
        WHEN good >= 0.7 THEN 'B+' WHEN good >= 0.6 THEN 'B' WHEN good >= 0.45 THEN 'C+' WHEN good >= 0.3 THEN 'C' ELSE 'D' END""",
    "reviews_of": """reviews_of(entity BIGINT) RETURNS TABLE(entity_id BIGINT, clarity DOUBLE, helpful DOUBLE, date STRING)
        RETURN SELECT l_suppkey, CAST(1 + CAST(floor((l_quantity - 1) / 10) AS INT) AS DOUBLE), CAST(1 + l_partkey % 5 AS DOUBLE), date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss')
        FROM lineitem WHERE l_suppkey = reviews_of.entity""",
    "rating_counts": f"""rating_counts(threshold DOUBLE DEFAULT {THRESHOLDS['good']}D) RETURNS TABLE(entity_id BIGINT, n BIGINT, n_above BIGINT)
        RETURN SELECT entity_id, count(*), count_if(above) FROM (SELECT l_suppkey AS entity_id,
        (1 + CAST(floor((l_quantity - 1) / 10) AS INT) + 1 + l_partkey % 5) / 2 >= rating_counts.threshold AS above FROM lineitem) GROUP BY entity_id""",
    "last_events": """last_events(kind STRING) RETURNS TABLE(user_id BIGINT, event_id BIGINT)
        RETURN SELECT user_id, max_by(event_id, struct(ts, event_id)) FROM events WHERE event_type = last_events.kind GROUP BY user_id""",
}


class Admitted:
    """Rows (key, id, seconds) of one key in order of time -> key, id, allowed: at most `limit` accepted in any `window`."""

    def __init__(self) -> None:
        self.held: list[float] = []

    def eval(self, row, limit: int, window: float) -> Iterator[tuple]:
        allowed, self.held = admit([row["at"]], self.held, limit, window)
        yield row["k"], row["id"], allowed[0]


def register(spark: SparkSession) -> list[str]:
    """Makes every function known to the session, and gives their names. Table functions read the views of their tables."""
    for definition in FUNCTIONS.values():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
    spark.udtf.register("admitted", udtf(Admitted, returnType="k bigint, id bigint, allowed boolean"))
    return [*FUNCTIONS, "admitted"]
