"""Queries with Python workers run from any working folder: the package goes to the executors."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master({master!r}).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.executor.memory", "700m").getOrCreate()
print("rows", e.queries()[{name!r}](spark, {data!r}).count())
spark.stop()
"""


@pytest.mark.parametrize("name,master", [("admitted_requests", "local[2]"), ("rating_trend", "local-cluster[1,2,1024]")])
def test_workers_find_the_package(sf_dir, tmp_path, name, master):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = RUN.format(root=ROOT, name=name, data=sf_dir, master=master)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
