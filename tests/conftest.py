"""One Spark session for all tests, the driver's smallest tables, and a comparison with DuckDB."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    builder = SparkSession.builder.master("local[8]").appName("tests")
    for k, v in conf.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.5f}"
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    """Rows as sorted tuples of the columns in order of name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def same_as_sql(df: DataFrame, sql: str, folder: str) -> None:
    """The rows of a DataFrame are those of a query that DuckDB runs on the parquet tables of a folder."""
    with duckdb.connect() as con:
        for path in Path(folder).glob("*.parquet"):
            files = f"{path}/*.parquet" if path.is_dir() else path
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
        got = con.execute(sql)
        columns = [c[0] for c in got.description]
        assert sorted(columns) == sorted(df.columns)
        want = rows_of(columns, got.fetchall())
    assert rows_of(df.columns, df.collect()) == want
