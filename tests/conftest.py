import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    return con


def plain(value):
    """Values of either engine in one form."""
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def same_rows(df, relation):
    """Compares a Spark result with a DuckDB one, columns by name, rows in any order."""
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [relation.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    ours = [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in ours]
    theirs = [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in theirs]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)
