"""Stores with odd names, loads of ticks, checks of panels and outputs, machines on bad closes."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.indicators import INDICATORS
from barloom.functions.windows import lead, rolling
from barloom.operators import checks as ck
from barloom.operators import portfolio as pf
from barloom.operators import strategies as st
from barloom.sources import research_store as rs
from barloom.sources import store, ticks


def day(k):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=k)


def bars(spark, series):
    rows = [(s, day(t), p, None if p is None else p + 0.5, None if p is None else p - 0.5, p, 10.0) for s, ps in series.items() for t, p in enumerate(ps)]
    return spark.createDataFrame(rows, "symbol string, eob timestamp_ntz, open double, high double, low double, close double, volume double").repartition(3)


# ---- stores


def test_names_of_digits_come_back_as_they_went(spark, tmp_path):
    root = str(tmp_path)
    rows = bars(spark, {"000001": [1.0, 2.0], "1": [3.0], "7e2": [4.0], "2020-01-01": [5.0]})
    store.save(rows, root, "1d")
    assert [r["symbol"] for r in store.list_symbols(spark, root, "1d").collect()] == sorted(["000001", "1", "7e2", "2020-01-01"])
    assert sorted(r["close"] for r in store.read(spark, root, "1d", ["000001"]).collect()) == [1.0, 2.0]
    assert [r["close"] for r in store.read(spark, root, "1d", ["1"]).collect()] == [3.0]
    store.save(bars(spark, {"000001": [9.0]}), root, "1d")  # replaces its own partition only
    assert store.read(spark, root, "1d").count() == 4
    with pytest.raises(FileNotFoundError):
        store.read(spark, root, "1d", ["01"])
    events = spark.createDataFrame([("000001", dt.date(2020, 1, 2), 1.5), ("1", dt.date(2020, 1, 3), 2.5)], "symbol string, ex_date date, factor double")
    rs.save_adjustments(events, root)
    assert rs.list_adjustments(spark, root) == ["000001", "1"]
    assert [r["factor"] for r in rs.read_adjustments(spark, root, "000001").collect()] == [1.5]


def test_market_queries_and_combined_imports(spark, tmp_path):
    path = tmp_path / "all.csv"
    path.write_text("symbol,eob,open,high,low,close,volume\n000002,2020-01-01 01:00:00,1,2,0,1.5,3\n000003,2020-01-01 01:00:00,1,2,0,2.5,3\n")
    assert store.import_combined(spark, str(path), str(tmp_path), "1d", "UTC") == ["000002", "000003"]
    before = {t.name for t in spark.catalog.listTables()}
    out = store.market(spark, str(tmp_path), "1d", "SELECT symbol, max(close) AS top FROM market GROUP BY symbol", ["000003"])
    assert [tuple(r) for r in out.collect()] == [("000003", 2.5)] and {t.name for t in spark.catalog.listTables()} == before


# ---- machines


def test_machines_pass_over_bad_closes(spark):
    rng, price, good = random.Random(3), 100.0, []
    for _ in range(300):
        price *= 1 + rng.uniform(-0.03, 0.032)
        good.append(price)
    bad = list(good)
    for t, p in ((150, None), (151, None), (200, 0.0), (230, -5.0), (299, None)):
        bad[t] = p
    both = bars(spark, {"good": good, "bad": bad, "none": [None] * 80, "zero": [0.0] * 80})
    for machine in (st.donchian_weights, lambda d: st.donchian_weights(d, sizing="fixed"), st.core_satellite_weights, st.trend_weights, st.vol_recovery_weights, pf.reversion_stop):
        out = machine(both).collect()
        assert len(out) == both.count()
    fixed = {(r["symbol"], r["eob"]): r["weight"] for r in st.donchian_weights(both, sizing="fixed").collect()}
    assert set(fixed.values()) == {0.0, 1.0} and fixed["bad", day(150)] == fixed["bad", day(149)]
    assert all(v == 0 for (s, _), v in fixed.items() if s in ("none", "zero"))
    assert INDICATORS["supertrend"](both).count() == both.count()
    with pytest.raises(ValueError):
        st.donchian_weights(both, sizing="none")


# ---- ticks


def pairs(df):
    return sorted((r["symbol"], str(r["date"])) for r in df.collect())


def pair_rows(spark, *xs):
    return spark.createDataFrame([(s, dt.date(2020, m, d)) for s, m, d in xs], "symbol string, date date")


def test_a_plan_after_a_partial_load_gives_the_gaps(spark):
    activity = pair_rows(spark, *[(s, 1, d) for s in "abcdefghijk" for d in (1, 2, 3)], ("a", 1, 1))
    done = pair_rows(spark, *[(s, 1, d) for s in "abcdefghij" for d in (1, 2)])
    tasks = ticks.plan(activity, done, pair_rows(spark, ("a", 1, 3)))
    assert pairs(tasks) == sorted([("k", "2020-01-01"), ("k", "2020-01-02"), *[(s, "2020-01-03") for s in "bcdefghijk"]])
    out = {(str(r["date"]), r["batch"]): r["symbols"] for r in ticks.batches(tasks, 4).collect()}
    assert out["2020-01-03", 0] == list("bcde") and out["2020-01-03", 2] == list("jk") and out["2020-01-01", 0] == ["k"]
    less = {(str(r["date"]), r["batch"]): r["symbols"] for r in ticks.without_pairs(ticks.batches(tasks, 4), pair_rows(spark, ("c", 1, 3), ("j", 1, 3), ("k", 1, 3))).collect()}
    assert less["2020-01-03", 0] == list("bde") and ("2020-01-03", 2) not in less
    assert ticks.plan(activity, activity).count() == 0 and ticks.plan(activity, activity, overwrite=True).count() == 33


def tick_rows(spark, rows, version=False):
    kind = "symbol string, date date, timestamp long, price double" + (", version int" if version else "")
    return spark.createDataFrame([(s, dt.date(2020, m, d), *rest) for s, m, d, *rest in rows], kind)


def test_months_are_laid_over_by_symbol_day(spark, tmp_path):
    root = str(tmp_path)
    assert ticks.stored_ticks(spark, root) is None
    ticks.merge_months(spark, root, tick_rows(spark, [("a", 1, 2, 20, 1.0, 1), ("a", 1, 2, 10, 2.0, 1), ("b", 2, 1, 5, 3.0, 1)], True))
    ticks.merge_months(spark, root, tick_rows(spark, [("a", 1, 2, 11, 7.0, 1), ("a", 1, 2, 12, 8.0, 2), ("a", 1, 2, 13, 8.5, 2), ("a", 1, 3, 5, 9.0, 1)], True))
    got = sorted((r["month"], r["symbol"], r["seq"], r["timestamp"], r["price"]) for r in ticks.stored_ticks(spark, root).collect())
    assert got == [("202001", "a", 1, 5, 9.0), ("202001", "a", 2, 12, 8.0), ("202001", "a", 3, 13, 8.5), ("202002", "b", 1, 5, 3.0)]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("aside")]


def test_loads_are_reported(spark):
    activity = pair_rows(spark, ("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("a", 3, 1), ("b", 3, 1))
    book = spark.createDataFrame([("a", dt.date(2020, 1, 1), 2, 1, [1.0] * 5), ("a", dt.date(2020, 1, 1), 1, 2, [1.0] * 4), ("a", dt.date(2020, 2, 1), 1, 1, None)], "symbol string, date date, timestamp long, seq int, bid_price array<double>")
    none, late = pair_rows(spark, ("a", 3, 1)), pair_rows(spark, ("b", 3, 1))
    faults = sorted(tuple(r) for r in ticks.month_faults(activity, book, none).collect())
    assert faults == [("202001", "bad_five_level_bid_price", 1), ("202001", "timestamp_not_monotonic", 1), ("202002", "bad_five_level_bid_price", 1), ("202003", "missing_file", 0)]
    out = ticks.load_report(activity, book, none, late).first()
    assert (out["expected"], out["observed"], out["rows"], out["no_data"], out["timed_out"], out["missing"], out["faults"], out["status"]) == (5, 2, 3, 1, 1, 2, 4, "failed")
    missing = ticks.gaps(activity, book, none, late)
    assert pairs(missing) == [("a", "2020-01-02")] == pairs(ticks.retries(activity, missing, ticks.month_faults(activity, book)))
    assert ticks.retries(activity, missing.where("false"), ticks.month_faults(activity, book)).count() == 5
    assert ticks.retries(activity, missing.where("false"), ticks.month_faults(activity, book).where("false")).count() == 0
    summary = {r["month"]: tuple(r)[1:] for r in ticks.month_summary(activity, book, book).collect()}
    assert summary == {"202001": (2, 2, 1), "202002": (1, 1, 0), "202003": (0, 2, 2)}


def test_results_names_ranges_and_priorities(spark):
    results = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1, "failed"), ("a", dt.date(2020, 1, 1), 2, "ok"), ("b", dt.date(2020, 1, 1), 1, "failed")], "symbol string, date date, version int, status string")
    assert pairs(ticks.failed_last(results)) == [("b", "2020-01-01")]
    assert sorted(r["status"] for r in ticks.recovered(results, pair_rows(spark, ("b", 1, 1))).collect()) == ["failed", "ok", "skipped"]
    assert pairs(ticks.no_data(results.withColumn("rows", F.col("version") - 2))) == [("a", "2020-01-01")]
    spans = spark.createDataFrame([(dt.date(2016, 2, 29), dt.date(2027, 1, 1)), (dt.date(2020, 1, 1), dt.date(2020, 1, 1))], "a date, b date")
    got = sorted((r["a"], r["part"], str(r["from"]), str(r["to"])) for r in ticks.date_ranges(spans, "a", "b").collect())
    assert [g[2:] for g in got] == [("2016-02-29", "2021-02-28"), ("2021-03-01", "2026-03-01"), ("2026-03-02", "2027-01-01"), ("2020-01-01", "2020-01-01")]
    with pytest.raises(Exception, match="ends before it starts"):
        ticks.date_ranges(spans.select(F.col("b").alias("a"), F.col("a").alias("b")), "a", "b").collect()
    names = spark.createDataFrame([("AG",), ("cu",), ("AU",)], "underlying string")
    assert [r["underlying"] for r in ticks.prioritized(names, [" CU", "zz"]).orderBy("place").collect()] == ["cu", "AG", "AU"]
    listed = spark.createDataFrame([("AG", dt.date(2012, 5, 1)), ("AG", dt.date(2013, 5, 1)), ("CU", None)], "underlying string, listed_date date")
    assert {r["underlying"]: str(r["start"]) for r in ticks.effective_start(listed, "2010-01-01").collect()} == {"AG": "2012-05-01", "CU": "2010-01-01"}
    row = spark.createDataFrame([("A/B:C", "12.7"), ("x", "no")], "symbol string, n string").agg(F.max(ticks.safe_name("symbol")).alias("s"), ticks.amount("n").alias("n"), F.min(ticks.month_key(F.lit("2020-03-04"))).alias("m")).first()
    assert tuple(row) == ("x", 12, "202003")


# ---- panels and outputs


def test_each_broken_rule_has_a_row(spark):
    rows = spark.createDataFrame(
        [("a", day(0), 1.0, 2.0, 0.5, 1.0, 1.0), ("a", day(0), 1.0, 2.0, 0.5, 1.0, float("nan")), (" ", day(1), 1.0, 0.1, 0.5, 1.0, float("inf")), (None, None, 1.0, 2.0, 0.5, 1.0, None), ("b", day(2), 3.0, 2.0, 0.5, 0.1, 2.0)],
        "symbol string, eob timestamp_ntz, open double, high double, low double, close double, volume double",
    )
    out = {r["code"]: r for r in ck.validate_panel(rows.withColumn("name", F.lit("x")), ("close", "volume", "name", "gone"), allowed=("close",), universe=("a",), least_coverage=0.9).collect()}
    failed = {c: (r["severity"], r["detail"]) for c, r in out.items() if not r["passed"]}
    assert failed == {
        "symbol_names": ("hard_fail", "2"), "times": ("hard_fail", "1"), "unique_keys": ("hard_fail", "1"), "symbol_times": ("hard_fail", "1"), "bars": ("soft_fail", "4"), "infinite:volume": ("soft_fail", "1"),
        "coverage": ("soft_fail", "0.4"), "required_fields": ("hard_fail", "gone"), "allowed_fields": ("hard_fail", "volume,name,gone"), "numeric:name": ("hard_fail", "string"), "universe": ("hard_fail", "3"), "panel": ("info", ""),
    }
    clean = {r["code"]: r["passed"] for r in ck.validate_panel(bars(spark, {"a": [1.0, 2.0]}), ("close",)).collect()}
    assert all(clean.values()) and "panel" in clean
    assert {r["code"]: r["passed"] for r in ck.validate_panel(rows.drop("eob")).collect()} == {"levels": False, "panel": False}


def test_levels_are_told_or_refused(spark):
    rows = spark.createDataFrame([(1, dt.date(2020, 1, 1), day(0), 5)], "name int, d date, t timestamp_ntz, x int")
    assert ck.identify_levels(rows, "name", "t") == ("name", "t") and ck.identify_levels(rows.drop("t"), "name") == ("name", "d")
    for wrong in (lambda: ck.identify_levels(rows, "name"), lambda: ck.identify_levels(rows, "gone", "t"), lambda: ck.identify_levels(rows, "name", "x"), lambda: ck.identify_levels(rows.select("d"), "d")):
        with pytest.raises(ValueError):
            wrong()
    own = ck.normalized(rows, ("x",), "name", "t")
    assert dict(own.dtypes)["symbol"] == "string" and dict(own.dtypes)["x"] == "double"
    back = ck.restored(own.select("symbol", "eob", (F.col("x") * 2).alias("value")), rows, "name", "t").first()
    assert back["value"] == 10.0 and back["d"] == dt.date(2020, 1, 1)
    with pytest.raises(ValueError):
        ck.normalized(rows, ("gone",), "name", "t")


def test_content_is_free_of_order_and_changes_with_a_cell(spark):
    rows = bars(spark, {"a": [1.0, None, 3.0], "b": [-0.0, 5.0]})
    digest = lambda df: ck.content_hash(df).first()["digest"]
    first = digest(rows)
    assert first == digest(rows.orderBy(F.desc("close")).repartition(7)) == digest(rows.select("volume", "close", "low", "high", "open", "eob", "symbol"))
    others = [rows.withColumn("volume", F.when(F.col("close") == 3, 11.0).otherwise(F.col("volume"))), rows.where("close IS NOT NULL"), rows.union(rows.where("close = 3")), rows.withColumn("close", F.coalesce("close", F.lit(0.0))), rows.withColumnRenamed("volume", "amount"), rows.withColumn("volume", F.col("volume").cast("int"))]
    assert len({first, *map(digest, others)}) == 1 + len(others)
    assert digest(rows.where("false")) != first
    assert {r["symbol"]: r["rows"] for r in ck.content_hash(rows, ("symbol",)).collect()} == {"a": 3, "b": 2}


def test_payloads_come_back(spark):
    rows = spark.createDataFrame([("a", day(1), 1.5), ("a", day(0), float("nan")), ("a", day(2), float("-inf")), ("b", day(0), None), ("b", day(1), 1e-300)], "symbol string, eob timestamp_ntz, value double")
    again = ck.from_payload(ck.to_payload(rows))
    assert ck.content_hash(again.select(*rows.columns)).first() == ck.content_hash(rows).first()


def test_a_look_ahead_is_caught(spark):
    rng = random.Random(1)
    rows = bars(spark, {s: [rng.uniform(1, 2) for _ in range(12)] for s in "abc"})
    causal = ck.prefix_causality(rows, lambda d: d.withColumn("value", F.percent_rank().over(__import__("pyspark").sql.Window.partitionBy("eob").orderBy("close")) + rolling(F.avg, "close", 3, 1))).collect()
    assert len(causal) == 12 - 4 and all(r["passed"] for r in causal)
    ahead = {r["cut"]: r for r in ck.prefix_causality(rows, lambda d: d.withColumn("value", lead("close", 2)), cuts=[day(5), day(8)]).collect()}
    assert ahead[day(5)]["changed"] == 6 and ahead[day(5)]["first_changed"] == day(4) and ahead[day(5)]["rows"] == 18 and not ahead[day(8)]["passed"]
    whole = ck.prefix_causality(rows, lambda d: d.crossJoin(d.agg(F.avg("close").alias("m"))).withColumn("value", F.col("close") - F.col("m")), cuts=[day(6)]).first()
    assert not whole["passed"]
    with pytest.raises(ValueError):
        ck.prefix_causality(bars(spark, {"a": [1.0, 2.0]}), lambda d: d.withColumn("value", F.col("close")))


def test_outputs_stand_beside_their_panel(spark):
    rows = bars(spark, {"a": [1.0] * 6, "b": [1.0] * 6})
    values = rows.select("symbol", "eob", F.when(F.col("eob") >= day(2), 1.0).alias("value")).withColumn("ok", F.col("value").isNotNull())
    say = lambda v, **k: {r["code"]: (r["passed"], r["detail"]) for r in ck.alignment(rows, v, **k).collect()}
    assert all(p for p, _ in say(values, valid="ok", warmup=2, missing="drop_nan").values())
    assert say(values, warmup=1)["warmup"] == (False, "1")
    broken = values.where((F.col("symbol") == "a") | (F.col("eob") != day(3))).union(values.where((F.col("symbol") == "a") & (F.col("eob") == day(4)))).withColumn("value", F.when(F.col("eob") == day(5), float("inf")).otherwise(F.col("value")))
    out = say(broken, valid="ok")
    assert out["duplicate_keys"] == (False, "1") and out["keys"] == (False, "1") and out["infinite"] == (False, "2") and out["valid_flag"][0] is False and out["holes"] == (False, "3")
    with pytest.raises(ValueError):
        ck.alignment(rows, values, missing="fill")
