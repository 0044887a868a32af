"""Small cases worked out by hand, and plans."""

from __future__ import annotations

from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import windows as w
from barloom.operators import attribution as at
from barloom.operators import cross_section as cs
from barloom.operators import market as mk
from barloom.operators import portfolio as pf
from barloom.plans import formula, panel_queries
from barloom.sources import panels, store
from barloom.streaming import bars as stream

FOLDER = "/root/testdata/sf0.001"


def series(spark, closes, symbol="A", **more):
    rows = [(symbol, date(2024, 1, i + 1), c, c, c, c, 1000.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, eob date, open double, high double, low double, close double, volume double")


def test_backtest_without_cost(spark):
    daily = pf.daily_result(series(spark, [100.0, 110.0, 121.0]).withColumn("weight", F.lit(1.0)), signal_lag=0, cost_rate=0.0)
    assert [round(r["ret"], 9) for r in daily.orderBy("eob").collect()] == [0.1, 0.1]
    assert round(pf.metrics(daily).first()["total_return"], 9) == 0.21


def test_constant_rank_ic_is_one(spark):
    rows = [(s, date(2024, 1, d), float(i), float(i) * d) for d in (1, 2, 3) for i, s in enumerate("ABC", 1)]
    out = cs.rank_ic(spark.createDataFrame(rows, "symbol string, eob date, f double, r double"), "f", "r", 3).collect()
    assert [round(r["ic"], 9) for r in out] == [1.0, 1.0, 1.0]


def test_average_rank_is_that_of_pandas(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 3.0]
    df = spark.createDataFrame([(str(i), date(2024, 1, 1), v) for i, v in enumerate(values)], "symbol string, eob date, x double")
    got = [r["k"] for r in df.withColumn("k", w.average_rank("x")).orderBy("symbol").collect()]
    want = pd.Series(values).rank().tolist()
    assert [a if a is not None else None for a in got] == [None if np.isnan(b) else b for b in want]


def test_ewm_is_that_of_pandas(spark):
    closes = [10.0, 11.0, 9.0, 12.0, 8.0]
    got = [r["e"] for r in w.smoothed(series(spark, closes), {"e": ("close", 0.3)}).orderBy("eob").collect()]
    assert np.allclose(got, pd.Series(closes).ewm(alpha=0.3, adjust=False).mean())


def test_one_event_halves_the_price(spark):
    events = spark.createDataFrame([("A", date(2024, 1, 2), 2.0, 2.0)], "symbol string, eob date, cum_factor double, factor double")
    out = mk.forward_adjust(series(spark, [10.0, 10.0]), events).orderBy("eob").collect()
    assert (out[0]["close"], out[0]["volume"], out[1]["close"]) == (5.0, 2000.0, 10.0)


def test_idle_bar_takes_the_last_close(spark):
    df = series(spark, [10.0, 99.0]).withColumn("volume", F.when(F.col("close") == 99, 0.0).otherwise(5.0))
    assert mk.repair_idle(df).orderBy("eob").collect()[1]["open"] == 10.0


def test_five_minutes(spark):
    rows = [("A", datetime(2024, 1, 2, 9, 30 + m), float(m), float(m + 1), float(m - 1), float(m), 10.0 * m) for m in range(1, 6)]
    bars = spark.createDataFrame(rows, "symbol string, eob timestamp_ntz, open double, high double, low double, close double, volume double")
    out = mk.resample_5m(bars).collect()
    assert len(out) == 1 and out[0]["bar"] == datetime(2024, 1, 2, 9, 35)
    assert (out[0]["open"], out[0]["high"], out[0]["low"], out[0]["close"], out[0]["volume"]) == (1.0, 6.0, 0.0, 5.0, 150.0)


def test_suspended_symbol_keeps_its_weight_and_buys_share_cash(spark):
    rows = [("s", date(2024, 1, 1), "A", 0.8, False), ("s", date(2024, 1, 1), "B", 0.2, False), ("s", date(2024, 1, 2), "A", 0.0, True), ("s", date(2024, 1, 2), "B", 1.0, False)]
    df = spark.createDataFrame(rows, "strategy_id string, eob date, symbol string, weight double, suspended boolean").withColumns({"limit_up": F.lit(False), "limit_down": F.lit(None)})
    got = pf.constrained(df).collect()
    assert {(r["eob"].day, r["symbol"]): round(r["executed"], 9) for r in got} == {(1, "A"): 0.8, (1, "B"): 0.2, (2, "A"): 0.8, (2, "B"): 0.2}
    assert {(r["eob"].day, round(r["blocked_buy_weight"], 9), round(r["blocked_sell_weight"], 9), round(r["cash_weight"], 9)) for r in got} == {(1, 0.0, 0.0, 0.0), (2, 0.8, 0.8, 0.0)}


def test_limits_stop_one_side_only(spark):
    days = [[("A", 0.5, False, True, False), ("B", 0.5, False, False, False)], [("A", 0.5, False, False, True), ("B", 0.1, False, True, False)], [("A", 0.0, False, False, True), ("B", None, False, False, False)]]
    rows = [(name, date(2024, 1, i + 1), *row) for name in ("s", "t") for i, day in enumerate(days) for row in day]
    df = spark.createDataFrame(rows, "strategy_id string, eob date, symbol string, weight double, suspended boolean, limit_up boolean, limit_down boolean")
    got = {(r["strategy_id"], r["eob"].day, r["symbol"]): (round(r["executed"], 9), round(r["cash_weight"], 9)) for r in pf.constrained(df).collect()}
    for name in ("s", "t"):
        assert [got[name, d, x] for d in (1, 2, 3) for x in "AB"] == [(0.0, 0.5), (0.5, 0.5), (0.5, 0.4), (0.1, 0.4), (0.5, 0.5), (0.0, 0.5)]


def test_limited_trading_of_many_strategies_agrees_with_plain_python(spark):
    """Small Arrow batches, so that a date goes over a batch's border; dates by plain Python, one after another."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = panel_queries.limited(spark, FOLDER)
        got = {(r["strategy_id"], r["eob"], r["symbol"]): r["executed"] for r in pf.constrained(rows).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plain: dict = {}
    for r in sorted(rows.select("strategy_id", "eob", "symbol", "weight", "suspended", "limit_up", "limit_down").collect()):
        plain.setdefault((r[0], r[1]), []).append(r[2:])
    wanted, have, last = {}, {}, None
    for (name, day), entries in plain.items():
        have, last = ({} if name != last else have), name
        now = {x: min(have.get(x, 0.0), have.get(x, 0.0) if stuck or down else goal) for x, goal, stuck, _, down in entries}
        buys = {x: 0.0 if stuck or up else max(0.0, goal - have.get(x, 0.0)) for x, goal, stuck, up, _ in entries}
        share = min(1.0, max(0.0, 1 - sum(now.values())) / sum(buys.values())) if sum(buys.values()) else 0.0
        have = {x: now[x] + buys[x] * share for x in now}
        wanted |= {(name, day, x): v for x, v in have.items()}
    assert set(got) == set(wanted) and all(abs(got[k] - wanted[k]) < 1e-9 for k in got)


def test_reversion_rule_enters_below_the_mean(spark):
    out = pf.reversion_stop(series(spark, [10.0, 10.0, 9.0, 12.0, 5.0]), ma=3, span=2, multiplier=1.0).orderBy("eob").collect()
    assert [r["weight"] for r in out] == [0.0, 0.0, 1.0, 1.0, 0.0]


def test_shapley_shares_sum_to_the_whole(spark):
    values = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 2.0), (3, 6.0)], "mask int, value double")
    assert {r["player"]: r["shapley"] for r in at.exact_shapley(values, 2).collect()} == {0: 2.5, 1: 3.5}


def test_bootstrap_does_not_depend_on_partitions(spark):
    daily = spark.createDataFrame([(date(2024, 1, i + 1), float(i)) for i in range(20)], "eob date, ret double")
    one = at.block_bootstrap(daily, "ret", 8, 5, 3).orderBy("replicate").collect()
    two = at.block_bootstrap(daily.repartition(3), "ret", 8, 5, 3).orderBy("replicate").collect()
    assert one == two


def test_adjusted_p_values(spark):
    got = at.benjamini_hochberg(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p_value double")).orderBy("test").collect()
    assert [round(r["adjusted"], 6) for r in got] == [0.03, 0.04, 0.04]


@pytest.mark.parametrize("bad", [{"field": "secret"}, {"call": "lag", "args": [{"field": "close"}], "n": -1}, {"op": "**", "args": [{"const": 1}, {"const": 2}]}, {"const": True}, {"call": "lead", "args": [{"field": "close"}], "n": 1}, []])
def test_formula_rejects(bad):
    with pytest.raises(ValueError):
        formula.check(bad)


def test_store_round_trip(spark, tmp_path):
    bars = series(spark, [1.0, 2.0]).unionByName(series(spark, [3.0], "B")).withColumn("eob", F.col("eob").cast("timestamp_ntz"))
    store.save(bars, str(tmp_path), "1d")
    store.save(series(spark, [9.0], "B").withColumn("eob", F.col("eob").cast("timestamp_ntz")), str(tmp_path), "1d")
    assert store.read(spark, str(tmp_path), "1d", ["A", "B"]).agg(F.sum("close")).first()[0] == 12.0
    with pytest.raises(FileNotFoundError):
        store.read(spark, str(tmp_path), "1d", ["A", "C"])


def test_csv_times_become_local(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,eob,open,high,low,close,volume\nA,2024-01-01T01:00:00Z,1,1,1,1,5\n")
    assert store.from_csv(spark, str(tmp_path / "a.csv")).first()["eob"] == datetime(2024, 1, 1, 9)


def test_changed_event_is_found(spark):
    log = store.chained(spark.createDataFrame([("s", i, f"p{i}") for i in range(4)], "stream string, seq int, payload string"))
    assert store.broken(log).count() == 0
    assert {r["seq"] for r in store.broken(log.withColumn("payload", F.when(F.col("seq") == 2, "x").otherwise(F.col("payload")))).collect()} >= {2}


def test_stream_equals_batch(spark, tmp_path):
    events = panels.table(spark, FOLDER, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    live = stream.run_once(stream.stream_bars(stream.events_stream(spark, str(tmp_path / "in"), 10)), "live_bars", str(tmp_path / "cp"))
    assert sorted(live.collect()) == sorted(stream.stream_bars(events).collect())


def test_filters_and_columns_reach_the_scan(spark):
    plan = panels.brand_bars(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string>" in plan and "l_comment" not in plan


def test_top_n_is_limited_before_the_sort_ends(spark):
    plan = panel_queries.topn_weights(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_symbols_of_unknown_exchanges_stay_or_raise(spark):
    from pyspark.sql import functions as F

    from barloom.functions.features import to_prefixed, to_suffixed

    rows = [("SHSE.510300",), ("SHFE.RB99",), ("SHFE.99",), ("XX.1",), ("plain",), (None,)]
    got = spark.createDataFrame(rows, "s string").select(to_suffixed(F.col("s")).alias("a"), to_prefixed(to_suffixed(F.col("s"))).alias("b"), "s").collect()
    assert [r.a for r in got] == ["510300.SH", "RB_DOMINANT.SHF", "99.SHF", "XX.1", "plain", None]
    assert all(r.b == r.s for r in got)
    with pytest.raises(Exception, match="unknown exchange"):
        spark.createDataFrame(rows, "s string").select(to_suffixed(F.col("s"), strict=True)).collect()


def test_fractal_dimension_of_alternating_closes_is_one_and_of_lines_none(spark):
    from datetime import date, timedelta

    from barloom.functions.indicators import mr_fractal_dim

    rows = [("a", date(2024, 1, 1) + timedelta(i), 10.0 + i % 2) for i in range(70)] + [("b", date(2024, 1, 1) + timedelta(i), 10.0 + i) for i in range(70)] + [("c", date(2024, 1, 1) + timedelta(i), 5.0) for i in range(70)]
    got = mr_fractal_dim(spark.createDataFrame(rows, "symbol string, eob date, close double")).orderBy("symbol", "eob").collect()
    assert [r.value is None for r in got if r.symbol == "a"] == [True] * 59 + [False] * 11
    assert all(abs(r.value + 0.5) < 1e-9 for r in got if r.value is not None)
    assert all(r.value is None for r in got if r.symbol != "a")
