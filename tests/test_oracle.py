"""Differential test: every registered query against its DuckDB SQL on the smallest driver tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import compare, duck  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from conftest import SMALL  # noqa: E402

from cyclelake.plans import catalog  # noqa: E402

oracle_sql()
NAMES = sorted(catalog.ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_an_oracle():
    queries()
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0 and "discharge_capacity_retention" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(queries()[name](spark, SMALL), oracle_sql()[name], con)
    assert ok, msg


SPLIT_PATH = ["rolling_stats_20", "norm_p95", "fade_rate", "missing_cycles", "outliers_modz", "pipeline_features",
              "pipeline_global", "infinity_cleanup", "temperature_features"]


@pytest.mark.parametrize("hot_rows", ["0", "30"])
@pytest.mark.parametrize("name", SPLIT_PATH)
def test_split_path_matches_oracle(spark, con, name, hot_rows):
    """Groups forced through the skew-safe paths (tiny chunks: many halo borders) give the same rows: all
    groups (threshold 0), or the larger half of them next to plain windows for the rest (threshold 30)."""
    spark.conf.set("spark.cyclelake.hotGroupRows", hot_rows)
    spark.conf.set("spark.cyclelake.chunkRows", "4")
    try:
        ok, msg = compare(queries()[name](spark, SMALL), oracle_sql()[name], con)
    finally:
        spark.conf.unset("spark.cyclelake.hotGroupRows")
        spark.conf.unset("spark.cyclelake.chunkRows")
    assert ok, msg


@pytest.mark.parametrize("name", ["time_bins", "cycle_age", "pipeline_features"])
def test_results_do_not_depend_on_session_time_zone(spark, con, name):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        ok, msg = compare(queries()[name](spark, SMALL), oracle_sql()[name], con)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert ok, msg
