"""Every signal query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from pairwave.plans import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in oracle.SQL:
        want = duck.execute(oracle.SQL[name]).df()
        c = sorted(got.columns)
        assert c == sorted(want.columns)
        a, b = (x[c].sort_values(c).reset_index(drop=True) for x in (got, want))
        assert len(a) == len(b) and (a.eq(b) | (a.isna() & b.isna())).all().all()


def test_entry_from_elsewhere(tmp_path):
    """Called in another folder and without PYTHONPATH, a query still finds the package in each Python process, a stream's included."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {top!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
print("rows", __spark_entry__.queries()["processor_control"](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "rows 1000" in done.stdout, done.stderr[-2000:]
