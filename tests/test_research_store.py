"""The research store: what is saved comes back, results are replaced or added to as they should be."""

from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from barloom.sources import research_store as rs


def test_factor_round_trip(spark, tmp_path):
    root = str(tmp_path)
    values = spark.createDataFrame([("A", date(2024, 1, 1), 1.0), ("B", date(2024, 1, 1), None)], "symbol string, eob date, value double")
    assert rs.read_factor(spark, root, "x", "mom", {"n": 5}) is None
    rs.save_factor(values, root, "x", "mom", {"n": 5, "m": 1})
    assert sorted(rs.read_factor(spark, root, "x", "mom", {"m": 1, "n": 5}).collect()) == sorted(values.collect())
    assert rs.read_factor(spark, root, "x", "mom", {"n": 6}) is None
    rs.save_factor(values.limit(1), root, "x", "mom", {"n": 5, "m": 1})
    assert rs.read_factor(spark, root, "x", "mom", {"n": 5, "m": 1}).count() == 1
    with pytest.raises(ValueError):
        rs.save_factor(values, root, "../y", "mom")


def test_factor_tests_keep_the_latest_of_each_setting(spark, tmp_path):
    root = str(tmp_path)
    groups = spark.createDataFrame([(date(2024, 1, d), g, 0.1 * g) for d in (1, 2) for g in (1, 2)], "eob date, grp int, ret double")
    assert rs.factor_tests(spark, root) is None
    for mean in (0.1, 0.3):
        ic = spark.createDataFrame([(date(2024, 1, d), mean + 0.01 * d) for d in range(1, 6)], "eob date, ic double")
        rs.save_factor_test(root, "x", "mom", ic, groups, turnover=groups)
    rs.save_factor_test(root, "y", "mom", ic, groups, n=5)
    got = {(r["namespace"], r["n"]): r for r in rs.factor_tests(spark, root).collect()}
    assert set(got) == {("x", 1), ("y", 5)} and abs(got["x", 1]["IC_mean"] - 0.33) < 1e-12 and got["x", 1]["IC_count"] == 5
    assert abs(got["x", 1]["top_group_cum_return"] - 0.44) < 1e-12 and abs(got["x", 1]["long_short_return"] - 0.23) < 1e-12
    assert rs.factor_tests(spark, root, "namespace = 'y' AND abs(IC_IR) > 0.3").count() == 1
    assert rs.read_ics(spark, root, "x", "mom").count() == 5 and rs.read_group_returns(spark, root, "x", "mom").count() == 4
    with pytest.raises(FileNotFoundError):
        rs.read_ics(spark, root, "x", "vol")
    assert len(rs.clear_namespace(spark, root, "x")) == 2 and rs.factor_tests(spark, root).count() == 1


def test_backtests_correlations_adjustments_and_models(spark, tmp_path):
    root = str(tmp_path)
    daily = spark.createDataFrame([(date(2024, 1, 1), 0.01)], "eob date, ret double")
    weights = spark.createDataFrame([("A", date(2024, 1, 1), 1.0)], "symbol string, eob date, weight double")
    assert rs.backtests(spark, root) is None
    first = rs.save_backtest(root, "x", daily, weights, spark.range(1).select(F.lit(1.5).alias("sharpe_ratio")), "one", top_pct=0.2)
    second = rs.save_backtest(root, "x", daily, weights, spark.range(1).select(F.lit(0.5).alias("sharpe_ratio"), F.lit(0.1).alias("calmar_ratio")))
    assert first != second and [r["run_id"] for r in rs.backtests(spark, root, "sharpe_ratio > 1").collect()] == [first]
    assert rs.read_backtest(spark, root, "x", first).collect() == daily.collect() and rs.read_backtest_weights(spark, root, "x", second).collect() == weights.collect()
    table = spark.createDataFrame([("a", "b", 0.5)], "factor_a string, factor_b string, correlation double")
    rs.save_correlation(table, root, "x")
    assert rs.read_correlation(spark, root, "x").collect() == table.collect() and rs.read_correlation(spark, root, "x", rank=False) is None
    assert rs.list_adjustments(spark, root) == []
    rs.save_adjustments(spark.createDataFrame([("B", date(2024, 1, 1), 2.0), ("A", date(2024, 1, 1), 2.0)], "symbol string, ex_date date, ex_cum_factor double"), root)
    rs.save_adjustments(spark.createDataFrame([("A", date(2024, 1, 1), 3.0)], "symbol string, ex_date date, ex_cum_factor double"), root)
    assert rs.list_adjustments(spark, root) == ["A", "B"] and rs.read_adjustments(spark, root, "A").first()["ex_cum_factor"] == 3.0
    with pytest.raises(FileNotFoundError):
        rs.read_adjustments(spark, root, "C")
    assert rs.list_models(spark, root, "x") is None
    for name, made in (("m1", "2024-01-01"), ("m2", "2024-02-01")):
        (tmp_path / "models" / "x" / name).mkdir(parents=True)
        (tmp_path / "models" / "x" / name / "metadata.json").write_text(json.dumps({"model_id": name, "created_at": made}))
    assert [r["model_id"] for r in rs.list_models(spark, root, "x").collect()] == ["m2", "m1"] and rs.model_metadata(spark, root, "x", "m1")["created_at"] == "2024-01-01"
    with pytest.raises(FileNotFoundError):
        rs.model_metadata(spark, root, "x", "m3")
