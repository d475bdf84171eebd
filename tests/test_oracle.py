"""Every query with SQL against DuckDB on the small tables; those without, that they run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.catalog.ORACLES.items()}


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(row):
    return tuple(round(float(x), 9) + 0.0 if isinstance(x, float) and math.isfinite(x) else x for x in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((plain(x) for x in df.select(*cols).collect()), key=str)
    want = sorted((plain(x) for x in duck.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()), key=str)
    assert len(got) == len(want) and got
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.catalog.QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert entry.catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_durations_and_sizes_of_odd_prices(spark, tmp_path):
    prices = [None, 0.0, 59.5, 10485.75, 10485.76, 13107.2, 23592.96, 44564.48, 76021.76, 12058.624, 104857.59, 104857.6, 499999.99]
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = sorted(tuple(x) for x in entry.catalog.QUERIES["filename_durations"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(SQL["filename_durations"]).fetchall()) and got[5][2] == "1.2 MB"
