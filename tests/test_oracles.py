"""Every registered query of the stylometry engine: against DuckDB where SQL can express it, else that it runs whole."""

from __future__ import annotations

import random

import duckdb
import pytest

from inkwell import plans
from tests.conftest import same_as_sql

QUERIES, SQL = plans.gathered()


@pytest.mark.parametrize("name", SQL)
def test_same_as_sql(spark, sf_dir, name):
    same_as_sql(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
    spark.catalog.clearCache()


def test_mattr_ties_are_rounded_as_in_sql(spark, tmp_path):
    """Of 32 or 160 windows every odd sum of types is a tie at six decimals; equal to the last digit, not to five as above."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(2 + i % 150)}" for _ in range(131 if i % 2 else 259)) for i in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'a' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    with duckdb.connect() as con:
        for name in ("documents", "labels"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        want = dict(con.execute(SQL["mattr_100"]).fetchall())
    got = {r.chunk_id: r.mattr_100 for r in QUERIES["mattr_100"](spark, str(tmp_path)).collect()}
    assert len(want) == len(texts) and got == want
    whole = {r.chunk_id: r.mattr_100 for r in QUERIES["all_metrics"](spark, str(tmp_path)).collect()}
    assert whole == want


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
