"""Every query with SQL gives the rows that DuckDB gives, over the smallest tables."""

import glob
import os
import subprocess
import sys

import pandas as pd
import pytest

from tidemark.plans import registry

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def cell(x):
        if x is None or x is pd.NA or x != x:
            return None
        if isinstance(x, float) and x.is_integer():
            return int(x)
        return round(x, 6) if isinstance(x, float) else str(x) if not isinstance(x, (int, bool)) else x

    return sorted((tuple(cell(x) for x in r) for r in frame.astype(object).values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_channels_that_are_silent_all_day_equal_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-02 03:00:00' + to_hours((i * 7)::INT) AS ts, i % 3 AS user_id, ['click', 'view'][i % 2 + 1] AS event_type, CASE WHEN i % 2 = 0 THEN 0 ELSE i END::DOUBLE AS value, '' AS props FROM range(40) t(i)) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    got, want = registry.QUERIES["channel_samples"](spark, str(tmp_path)).toPandas(), con.sql(registry.SQL["channel_samples"]).df()
    key = ["recording_id", "idx", "channel"]
    got, want = (d.sort_values(key).reset_index(drop=True)[sorted(d.columns)] for d in (got, want))
    assert (want["level"] == float("-inf")).any() and (want["level"] > -100).any()
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, atol=1e-6)


def test_sql_belongs_to_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_every_module_imports_on_its_own():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("product", "catalogue", "captures", "registry", "analysis", "comparison"):
        subprocess.run([sys.executable, "-c", f"from tidemark.plans import {name}"], cwd=root, check=True)
