"""Every registered query of the annotation operators against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pytest

from citeloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).astype(str).values.tolist()))
    assert key(got) == key(want)


def test_entry_and_import_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert int(out.stdout) >= 85
