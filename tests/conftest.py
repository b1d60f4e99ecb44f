from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Spark's Python workers

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from recordloom.rules import ORD  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        # tests that count scans list the executions of the whole session; 1,000 are kept by default
        .config("spark.sql.ui.retainedExecutions", "10000")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture
def table(spark):
    """An all-text table in the given row order."""

    def build(columns, rows):
        names = columns.split()
        schema = ", ".join(f"`{c}` string" for c in names) + f", {ORD} long"
        return spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], schema)

    return build


@pytest.fixture
def values(spark):
    """Evaluate a column expression on a list of single cells ``v``."""

    def run(cells, expression):
        schema = "i int, v string"
        df = spark.createDataFrame(list(enumerate(cells)), schema)
        rows = df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()
        return [row.out for row in rows]

    return run


def ordered(df):
    """Rows as dicts in row order, without it."""
    rows = df.orderBy(ORD).drop(ORD).collect()
    return [row.asDict() for row in rows]
