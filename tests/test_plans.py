"""Shapes of physical plans: scans and exchanges of queries that once repeated their sources."""

from __future__ import annotations

import pytest

from barloom.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def counts(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return {"scan": text.count("FileScan"), "exchange": text.count("Exchange "), "nested": text.count("BroadcastNestedLoopJoin")}


@pytest.mark.parametrize(
    ("name", "scans", "exchanges"),
    [("superiority_tests", 0, 12), ("screen_indicators", 2, 9), ("parameter_sweep", 2, 9), ("drawdown_episodes", 0, 6), ("backtest_daily", 0, 9), ("robustness_report", 4, 16), ("density_shapes", 8, 20)],
)
def test_sources_are_scanned_once(spark, name, scans, exchanges):
    got = counts(QUERIES[name](spark, FOLDER))
    assert got["scan"] <= scans and got["exchange"] <= exchanges, got


def test_boosted_rows_come_from_one_reading(spark):
    assert counts(QUERIES["boosted_barriers"](spark, FOLDER)) == {"scan": 0, "exchange": 0, "nested": 0}


@pytest.mark.parametrize("name", ["backtest_daily", "coverage_gaps", "risk_parity"])
def test_grids_need_no_nested_loops(spark, name):
    assert counts(QUERIES[name](spark, FOLDER))["nested"] == 0
