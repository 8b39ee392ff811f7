import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.local.dir", folder)
        .config("spark.checkpoint.dir", folder)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def docs(spark):
    """(doc_id, text) rows, with a column whose name clashes with the operators' own."""

    def make(*texts, first=0):
        rows = [(i, t, "x", 1.5, None) for i, t in enumerate(texts, first)]
        return spark.createDataFrame(rows, "doc_id long, text string, row string, base double, kept string")

    return make
