"""Every catalogue query with SQL must give the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from quillstone.plans import catalogue, catalogue_facade, catalogue_state, catalogue_text

assert all(more.QUERIES is catalogue.QUERIES for more in (catalogue_facade, catalogue_state, catalogue_text))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v)[:10] if type(v).__name__ in ("datetime", "date", "Timestamp") else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    want = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "rank", "chunk_id", "slug", "score"]


def test_no_cartesian_and_pruned_scan(spark, sf_dir):
    spark.catalog.clearCache()
    plan = catalogue.q01_keyword_search(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "n_chars" not in plan
