"""Grids of settings against runs of one setting at a time, and their figures against plain Python."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import grids as gr
from barloom.operators import strategies as st


def day(k):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def bars(spark):
    r, rows = np.random.default_rng(11), []
    for s in "ab":
        close = 100 * np.exp(np.cumsum(r.normal(size=400) * 0.02))
        rows += [(s, day(t), float(p), float(p * 1.01), float(p * 0.99), None if t == 77 else float(p), 1.0) for t, p in enumerate(close)]
    return spark.createDataFrame(rows, "symbol string, eob timestamp_ntz, open double, high double, low double, close double, volume double").repartition(3).cache()


def of(df):
    return {(r["symbol"], r["eob"]): r["weight"] for r in df.collect()}


def test_channels_are_those_of_single_runs(bars):
    grid = gr.channel_grid(bars, (10, 20), (5, 15), (7, 14), (2.0, 3.0)).cache()
    assert {r["config"] for r in grid.select("config").distinct().collect()} == {f"channel_{e}_{x}_{s}_{m}" for e, x in ((10, 5), (20, 5), (20, 15)) for s in (7, 14) for m in (2, 3)}
    for e, x, s, m in ((10, 5, 7, 2), (20, 15, 14, 3)):
        assert of(grid.where(F.col("config") == f"channel_{e}_{x}_{s}_{m}")) == of(st.donchian_weights(bars, e, x, s, float(m), sizing="fixed"))
    with pytest.raises(ValueError):
        gr.channel_grid(bars, (5,), (10,))


def test_satellites_are_those_of_single_runs(bars):
    few = dict(distances=(0.1, 0.15), defensives=(0.25,), longest_defences=(10, 15), strengths=(35.0, 45.0), oversolds=(1.5,), profits=(0.05,), stops=(0.05,), longests=(10,))
    grid = gr.satellite_grid(bars, **few, trend=40, slope=5, low=30).cache()
    assert grid.select("config").distinct().count() == 8
    one = lambda d, n, r: of(st.core_satellite_weights(bars, defensive=0.25, oversold=1.5, rsi_below=r, trend=40, slope=5, profit=0.05, stop=0.05, longest=10, low=30, distance=d, longest_defence=n))
    for k, (d, n, r) in enumerate([(d, n, r) for d in (0.1, 0.15) for n in (10, 15) for r in (35.0, 45.0)], 1):
        if k in (1, 4, 8):
            got = of(grid.where(F.col("config") == f"combined_{k:04d}"))
            assert got == one(d, n, r) and len(set(got.values())) > 1


def test_figures_and_ranks(bars):
    grid = gr.channel_grid(bars, (10, 20), (5,), (14,), (2.0,)).unionByName(gr.channel_grid(bars, (30,), (5,), (14,), (2.0,)).withColumns({"weight": F.lit(0.0), "config": F.lit("idle")}))
    figures = gr.grid_figures(bars, grid)
    got = {r["config"]: r for r in figures.collect()}
    wide = bars.toPandas().pivot(index="eob", columns="symbol", values="close")
    move = wide.shift(-1) / wide - 1
    for name in got:
        w = grid.where(F.col("config") == name).toPandas().pivot(index="eob", columns="symbol", values="weight").shift(1).fillna(0.0)
        t = w.diff().fillna(w).abs()
        keep = move.notna()
        ret = ((w * move).where(keep).mean(axis=1) - 0.0004 * t.where(keep).mean(axis=1)).dropna()
        base, equity = move.mean(axis=1).dropna(), (1 + ret).cumprod()
        assert abs(got[name]["total_return"] - (equity.iloc[-1] - 1)) < 1e-9 and abs(got[name]["max_drawdown"] - (1 - equity / equity.cummax()).max()) < 1e-9
        excess = (1 + ret).groupby(ret.index.year).prod() - (1 + base).groupby(base.index.year).prod()
        assert abs(got[name]["median_fold_excess"] - excess.median()) < 1e-9 and abs(got[name]["worst_fold_excess"] - excess.min()) < 1e-9
    ranked = {r["config"]: r for r in gr.rank_in_sample(figures).collect()}
    frame = pd.DataFrame([got[n].asDict() for n in got]).set_index("config")
    score = sum(frame[c].rank(pct=True).fillna(0.0) * w for c, w in gr.RANKED.items())
    assert not ranked["idle"]["eligible"] and ranked["idle"]["score"] is None and ranked["idle"]["place"] == 3
    assert all(abs(ranked[n]["score"] - score[n]) < 1e-12 for n in got if n != "idle")


def test_states_and_events_tell_the_weights(bars):
    args = dict(rsi_below=45.0, trend=40, slope=5, profit=0.05, stop=0.03, longest=10, low=30, distance=0.12, longest_defence=8, cooldown=2, recovery=0.01, defensive=0.25)
    rows = st.core_satellite_states(bars, **args).orderBy("symbol", "eob").collect()
    weights = of(st.core_satellite_weights(bars, **args))
    assert {(r["symbol"], r["eob"]): r["weight"] for r in rows} == weights
    assert {r["state"] for r in rows} >= {"core", "defensive", "oversold_satellite"}
    worth = {"core": 1.0, "recovery_wait": 1.0, "defensive": 0.25, "oversold_satellite": 1.5}
    before = {}
    for r in rows:
        assert r["weight"] == worth[r["state"]]
        was, events = before.get(r["symbol"], "core"), [e for e in r["event"].split("|") if e]
        if "defensive_entry" in events:
            assert r["state"] == "defensive"
        elif {"oversold_entry", "oversold_reentry_recovery"} & set(events):
            assert r["state"] == "oversold_satellite"
        if not events and was != r["state"]:
            assert (was, r["state"]) == ("recovery_wait", "core")  # the pullback ended
        if was == "defensive" and r["state"] != "defensive":
            assert events[0].startswith("defensive_exit_")
        if was == "oversold_satellite" and r["state"] in ("core", "recovery_wait"):
            assert any(e.startswith("oversold_exit_") for e in events)
        before[r["symbol"]] = r["state"]


def test_controls_steps_and_frames(bars):
    from barloom.operators import signals as sg

    assert [sg.rebalance_step(x) for x in ("d", "W", "M", "7", 3)] == [1, 5, 22, 7, 3]
    for bad in ("x", 0, "-1", "1.5"):
        with pytest.raises(ValueError):
            sg.rebalance_step(bad)
    book = bars.withColumn("weight", F.lit(0.5))
    twice = sg.controlled(book, [("universe_vol_exposure", {"window": 5, "span": 30, "least": 5, "gross": 0.6}), ("universe_vol_exposure", {"window": 5, "span": 30, "least": 5, "gross": 0.3})]).collect()
    assert {round(r["weight"], 9) for r in twice} == {0.5, 0.15} and all((r["weight"] < 0.5) == (r["active_0"] and r["active_1"]) for r in twice)
    with pytest.raises(ValueError):
        sg.controlled(book, [("unknown", {})]).count()
    with pytest.raises(ValueError):
        sg.factor_frame(bars, {"x": ("unknown", {})})
    assert {r["dates"] for r in sg.weight_counts(book).collect()} == {400}


def test_a_report_says_what_fails(bars):
    from barloom.functions.windows import lead, ratio
    from barloom.operators import signals as sg

    tree = {"op": "-", "args": [{"field": "close"}, {"call": "lag", "args": [{"field": "close"}], "n": 2}]}
    rows = {(r["part"], r["name"]): r for r in sg.factor_report(bars, tree, ratio(lead("close", 2), lead("close", 1)) - 1, [day(100), day(300)], least=2).collect()}
    assert rows["formula", "nodes"]["passed"] and rows["causality", "2020-04-10 00:00:00"]["passed"] and rows["panel", "unique_keys"]["passed"]
    assert ("ic", "ic_mean") in rows and ("slice", "base") in rows and abs(rows["ic", "ic_mean"]["value"] - rows["slice", "base"]["value"]) < 1e-12
    bad = {(r["part"], r["name"]): r for r in sg.preflight(bars.union(bars.limit(1)), {"call": "lead", "args": [{"field": "close"}], "n": 2}).collect()}
    assert not bad["panel", "unique_keys"]["passed"] and not next(r for (p, _), r in bad.items() if p == "formula")["passed"]
