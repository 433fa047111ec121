"""The library on the executors: Python workers that unpickle its functions need its modules, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def archive() -> str:
    """A zip of the package's modules as they are now."""
    path = os.path.join(tempfile.mkdtemp(prefix="tarnwell-"), "tarnwell.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(ROOT):
            for name in sorted(n for n in names if n.endswith(".py")):
                whole = os.path.join(folder, name)
                z.write(whole, os.path.relpath(whole, os.path.dirname(ROOT)))
    return path


def ship(spark: SparkSession) -> None:
    """Sends the package to the session's executors, once for each application; Spark hands it to those that join later."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        sc.addPyFile(archive())
        _SHIPPED.add(sc.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package on the executors first."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
