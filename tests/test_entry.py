import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("orders", "customer", "lineitem"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    got = entry.entry(spark).select("artist", "releases_total", "gap_median_days").collect()
    want = con.sql(f"select artist, releases_total, gap_median_days from ({entry.oracle_sql()['early_window_cadence']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
