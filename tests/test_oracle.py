"""Every engine query against its DuckDB SQL over the smallest tables."""

import glob
import os

import duckdb
import pytest

import barlane.plans.registry as registry

QUERIES = registry.queries()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    # Models fitted by iteration are held against brute force in their own tests.
    assert set(QUERIES) - set(SQL) == {"forecast_arima_110", "forecast_arima_211"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    duck.sql(f"CREATE OR REPLACE TABLE want AS {SQL[name]}")
    duck.register("got", got)
    kinds = lambda t: sorted((r[0], r[1]) for r in duck.sql(f"DESCRIBE {t}").fetchall())
    assert kinds("got") == kinds("want")
    cols = ", ".join(f'"{c}"' for c, _ in kinds("want"))
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall() == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_ends_under_a_limit(sf_dir, name):
    import threading

    folder = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else sf_dir
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    stop = threading.Timer(60, c.interrupt)
    stop.start()
    try:
        assert len(c.execute(f"SELECT * FROM ({SQL[name]}) LIMIT 5").fetchall()) <= 5
    finally:
        stop.cancel()


def test_streaming_windows_match_batch_windows(spark, sf_dir):
    from barlane.operators.windows import sample_windows
    from barlane.sources.fixtures import bars

    live = {(r["series_id"], r["start"], r["last_input"], r["last_target"]) for r in QUERIES["streaming_windows"](spark, sf_dir).collect()}
    batch = {(r["series_id"], r["start"], r["x"]["close"][-1], r["y"][-1]) for r in sample_windows(bars(spark, sf_dir)).collect()}
    assert live == batch


def test_forecast_udf_gives_ten_steps(spark, sf_dir):
    from barlane.operators.submission import validate

    validate(QUERIES["forecast_udf"](spark, sf_dir), strict=True)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
