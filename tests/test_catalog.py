"""Every registered query with SQL gives the rows that DuckDB finds in the same tables."""

import os

import duckdb
import pytest
from pyspark.sql import SparkSession

from gatewell.plans import cases, catalog  # noqa: F401  (cases registers its queries)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer orders events documents labels conversations pages benchmark".split()


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted((tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()))
    assert got
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        rows = duck.sql(f"select {', '.join(sorted(want.columns))} from ({catalog.ORACLES[name]})").fetchall()
        assert sorted(df.columns) == sorted(want.columns) and got == sorted(tuple(map(str, r)) for r in rows)
