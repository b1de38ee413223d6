"""Sources that hold only where driver and executors are processes of their own."""

import datetime
import importlib.util
import os
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest

from millrace import sources
from millrace.queries import _place
from tests.conftest import ROOT, SF

CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1024m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
print(sorted(tuple(r) for r in __spark_entry__.queries()[sys.argv[1]](spark, sys.argv[3]).collect()))
"""


def on_cluster(query, at):
    """The rows' text of a query whose executors are processes of their own."""
    home = Path(importlib.util.find_spec("pyspark").origin).parent
    (at / "home" / "work").mkdir(parents=True)
    for p in home.iterdir():  # executors write to work in Spark's home
        if p.name != "work":
            (at / "home" / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(at / "home"), "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13"}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS", "SPARK_ENV_LOADED", "_PYSPARK_DRIVER_CALLBACK_HOST")}
    done = subprocess.run([sys.executable, "-c", CLUSTER, query, f"file://{at}/shared", SF], env=env, cwd=at, capture_output=True, text=True, timeout=180)
    assert not done.returncode, done.stderr[-3000:]
    return done.stdout.strip().splitlines()[-1]


def test_jdbc_roundtrip_on_a_cluster(tmp_path):
    assert on_cluster("jdbc_roundtrip", tmp_path) == str([(k, 4) for k in range(5)])


def test_embedded_database_keeps_values_and_nulls(spark):
    rows = [(1, "a'b", 1.5, Decimal("2.50"), datetime.date(2020, 2, 29), datetime.datetime(2020, 1, 1, 12, 30), True), (2, None, None, None, None, None, None)]
    rows += [(k, "x", 0.0, Decimal("1.00"), datetime.date(2021, 1, 1), datetime.datetime(2021, 1, 1), False) for k in range(3, 3 + 2 * sources.BATCH)]
    frame = spark.createDataFrame(rows, "k bigint, s string, x double, d decimal(9,2), day date, at timestamp, yes boolean").repartition(3)
    url = sources.embedded_database(frame, "t", _place(spark, "jdbc"))
    assert sorted(map(tuple, sources.read_jdbc(spark, url, "t", "k", (0, 2000), 3).collect())) == rows
    none = sources.embedded_database(frame.filter("k < 0"), "t", _place(spark, "jdbc"))
    assert sources.read_jdbc(spark, none, "t").count() == 0


def test_embedded_database_wants_a_folder(spark):
    with pytest.raises(ValueError, match="mounted"):
        sources.embedded_database(spark.range(1), "t", "hdfs://there/x")


def test_jdbc_tablespace_on_a_cluster(tmp_path):
    assert on_cluster("jdbc_tablespace", tmp_path) == str([(r, 5) for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")])
