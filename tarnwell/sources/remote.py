"""Paged GraphQL sources as Spark data sources: one input partition for each search term, school name or entity.

`spark.dataSource.register(EntityListing)` makes it available as format "entity_listing", `SchoolSearch` and
`EntityReviews` likewise. The endpoint and the query are options; so are `pace`, the seconds between two pages of a
partition, and `limited_wait`, the seconds more to wait where the server limits requests (1; incremental runs take 2).
`fetched` asks for the rows of a table instead, however many they are.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from string import ascii_lowercase

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRIES = 4


def search_terms() -> list[str]:
    """One- and two-letter prefixes: together they reach every name."""
    return [*ascii_lowercase, *(a + b for a in ascii_lowercase for b in ascii_lowercase)]


def backoff(attempt: int, limited: bool, extra: int = 1) -> int:
    """Seconds to wait: 2^attempt, and `extra` more where the server limits requests."""
    return 2**attempt + (extra if limited else 0)


def http_post(url: str, body: dict, timeout: float = 15.0) -> tuple[int, dict]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, json.load(answer)
    except urllib.error.HTTPError as e:
        return e.code, {}


def fetch(post: Callable[[dict], tuple[int, dict]], body: dict, sleep: Callable[[float], None] = time.sleep, extra: int = 1) -> dict:
    """The answer, or {} after TRIES attempts."""
    for attempt in range(TRIES):
        try:
            status, data = post(body)
        except OSError:
            sleep(backoff(attempt, False))
            continue
        if status == 200:
            return data
        sleep(backoff(attempt, status == 429, extra))
    return {}


def pages(post: Callable[[dict], tuple[int, dict]], query: str, variables: dict, path: tuple[str, ...], most: int | None = None, sleep: Callable[[float], None] = time.sleep, extra: int = 1, pace: float = 0.0) -> Iterator[dict]:
    """Nodes of a cursor-paged connection found under `path`, at most `most`; `pace` seconds pass between two pages."""
    cursor, n = "", 0
    while True:
        if cursor and pace:
            sleep(pace)
        data = fetch(post, {"query": query, "variables": {**variables, "cursor": cursor}}, sleep, extra).get("data") or {}
        for key in path:
            data = (data or {}).get(key) or {}
        for edge in data.get("edges") or []:
            if most is not None and n >= most:
                return
            n += 1
            yield edge["node"]
        info = data.get("pageInfo") or {}
        if not info.get("hasNextPage"):
            return
        cursor = info.get("endCursor") or ""


@dataclass
class Term(InputPartition):
    text: str


class _Reader(DataSourceReader):
    """One partition for each text; rows (text, place, id, node as JSON). `variable` names what the text stands for."""

    def __init__(self, options: dict, texts: list[str], variable: str, path: str) -> None:
        self.url, self.query, self.school = options["url"], options["query"], options.get("school", "")
        self.most = int(options["most"]) if "most" in options else None
        self.extra, self.pace = int(options.get("limited_wait", "1")), float(options.get("pace", "0"))
        self.texts, self.variable, self.path = texts, variable, tuple(options.get("path", path).split("."))

    def partitions(self) -> list[Term]:
        return [Term(t) for t in self.texts]

    def read(self, partition: Term) -> Iterator[tuple]:
        post = lambda body: http_post(self.url, body)
        variables = {self.variable: partition.text} | ({"schoolID": self.school} if self.school else {})
        for place, node in enumerate(pages(post, self.query, variables, self.path, self.most, extra=self.extra, pace=self.pace)):
            yield partition.text, place, node.get("id"), json.dumps(node)


class _Source(DataSource):
    def schema(self) -> str:
        return "asked string, place int, id string, node string"


class EntityListing(_Source):
    """The entities found under every search term. Repeats across terms are for dropDuplicates(["id"]).

    Options: url, query, school, path, most (nodes of a term); terms, comma-separated, in place of all prefixes.
    """

    @classmethod
    def name(cls) -> str:
        return "entity_listing"

    def reader(self, schema) -> _Reader:
        terms = self.options.get("terms")
        return _Reader(self.options, terms.split(",") if terms else search_terms(), "text", "search.teachers")


class SchoolSearch(_Source):
    """The schools found by the names in the option `names` (comma-separated), in the service's order: the first is the hit."""

    @classmethod
    def name(cls) -> str:
        return "school_search"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, self.options["names"].split(","), "text", "newSearch.schools")


class EntityReviews(_Source):
    """The reviews of the entities in the option `ids` (comma-separated), newest first as the service has them."""

    @classmethod
    def name(cls) -> str:
        return "entity_reviews"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, self.options["ids"].split(","), "id", "node.ratings")


def fetched(asked: DataFrame, url: str, query: str, path: str, tasks: int, most: int | None = None, pace: float = 0.0, limited_wait: int = 1) -> DataFrame:
    """asked(key, variables map<string,string>) -> key, place, id, node (JSON): the nodes that each row's variables bring.

    At most `tasks` rows are asked for at a time, which with `pace` bounds the load on the service. The answers are not
    kept: store them before they are read twice.
    """
    way = tuple(path.split("."))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post = lambda body: http_post(url, body)
        for batch in batches:
            for row in batch.to_pylist():
                nodes = list(pages(post, query, dict(row["variables"]), way, most, extra=limited_wait, pace=pace))
                columns = [[row["key"]] * len(nodes), list(range(len(nodes))), [n.get("id") for n in nodes], [json.dumps(n) for n in nodes]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["key", "place", "id", "node"])

    return asked.select(F.col("key").cast("string"), "variables").repartition(tasks).mapInArrow(run, "key string, place int, id string, node string")
