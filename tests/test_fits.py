"""Fits and samples that SQL cannot say, against plain numpy."""

from __future__ import annotations

import datetime as dt
import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest

from barloom.operators import portfolio as pf
from barloom.operators import research as rs
from barloom.operators import summaries as sm


def day(k):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(7)
    rows = [(f"s{s}", day(t), *(float(v) for v in r.normal(size=2)), None if (s + t) % 17 == 0 else float(r.normal()), float(100 + r.normal())) for t in range(40) for s in range(7)]
    return spark.createDataFrame(rows, "symbol string, eob timestamp_ntz, a double, b double, y double, close double").repartition(4).cache(), rows


def of_day(rows, t, whole=True):
    return sorted(q for q in rows if q[1] == day(t) and (q[4] is not None or not whole))


def test_ridge_of_each_date(spark, panel):
    df, rows = panel
    got = {(q["eob"], q["term"]): q["beta"] for q in rs.regression_attribution(df, ["a", "b"], "y", 0.1).collect()}
    for t in range(40):
        own = of_day(rows, t)
        x, y = np.array([q[2:4] for q in own]), np.array([q[4] for q in own])
        x = np.column_stack([np.ones(len(y)), (x - x.mean(0)) / x.std(0)])
        beta = np.linalg.solve(x.T @ x + 0.1 * np.diag([0, 1, 1]), x.T @ y)
        assert np.allclose([got[day(t), k] for k in ("intercept", "a", "b")], beta)


def test_contributions_add_up(spark, panel):
    from pyspark.sql import functions as F

    df, rows = panel
    weighted = df.withColumn("w", F.when(F.col("a") > 0, F.col("a")))
    got = {(q["eob"], q["term"]): q for q in sm.factor_contributions(weighted, ["a", "b"], "y", "w", ridge=0.1).collect()}
    betas = {(q["eob"], q["term"]): q["beta"] for q in rs.regression_attribution(df, ["a", "b"], "y", 0.1).collect()}
    for t in range(40):
        own = of_day(rows, t)
        for k, term in enumerate(("a", "b")):
            x = np.array([q[2 + k] for q in own])
            exposure = sum(max(q[2], 0) * z for q, z in zip(own, (x - x.mean()) / x.std(), strict=True))
            row = got[day(t), term]
            assert abs(row["active_exposure"] - exposure) < 1e-9 and abs(row["contribution"] - exposure * betas[day(t), term]) < 1e-9 and row["status"] == "ok"
    few = sm.factor_contributions(weighted.where("symbol < 's2'"), ["a", "b"], "y", "w")
    out = {q["term"]: q for q in sm.summarize_contributions(few).collect()}
    assert out["a"]["skipped_days"] == out["a"]["n_days"] == 40 and out["a"]["total_contribution"] == 0.0 and out["a"]["avg_beta"] is None


def test_walk_forward_fits_only_what_came_before(spark, panel):
    df, rows = panel
    got = {(q["symbol"], q["eob"]): q for q in rs.walk_forward(df, ["a", "b"], "y", 15, 10, 2, 0.5).collect()}
    ranks = {}
    for t in range(40):
        own = of_day(rows, t, whole=False)
        for k in (2, 3):
            order = {q[0]: i + 1 for i, q in enumerate(sorted(own, key=lambda q, k=k: q[k]))}
            for q in own:
                ranks.setdefault((q[0], t), []).append(order[q[0]] / len(own) - 0.5)
    seen = 0
    for fold, begin in enumerate(range(15, 40, 10)):
        train = [(ranks[q[0], t], q[4]) for t in range(begin - 2) for q in of_day(rows, t)]
        x, y = np.column_stack([np.ones(len(train)), np.array([q[0] for q in train])]), np.array([q[1] for q in train])
        beta = np.linalg.solve(x.T @ x + 0.5 * np.eye(3), x.T @ y)
        for t in range(begin, min(begin + 10, 40)):
            for s in range(7):
                q = got[f"s{s}", day(t)]
                assert q["fold"] == fold and abs(q["score"] - (beta[0] + beta[1:] @ ranks[f"s{s}", t])) < 1e-9
                seen += 1
    assert seen == len(got)


def test_deflated_sharpe_is_the_formula(spark):
    x = np.random.default_rng(1).normal(0.05, 1, 300)
    out = rs.deflated_sharpe(spark.createDataFrame([(float(v),) for v in x], "ret double"), "ret", 20).first()
    sharpe, n, normal = x.mean() / x.std(ddof=1), len(x), NormalDist()
    z = (x - x.mean()) / x.std()
    top = (1 - 0.5772156649015329) * normal.inv_cdf(1 - 1 / 20) + 0.5772156649015329 * normal.inv_cdf(1 - 1 / (20 * math.e))
    spread = math.sqrt((1 - (z**3).mean() * sharpe + ((z**4).mean() - 1) / 4 * sharpe**2) / (n - 1))
    assert abs(out["sharpe"] - sharpe) < 1e-12 and abs(out["probability"] - normal.cdf((sharpe - top / math.sqrt(n - 1)) / spread)) < 1e-9
    assert rs.deflated_sharpe(spark.createDataFrame([(1.0,)], "ret double"), "ret", 20).first()["sharpe"] is None


def test_optimum_of_each_date(spark, panel):
    df, rows = panel
    scored = df.select("symbol", "eob", "close", df["a"].alias("score"))
    got = {(q["symbol"], q["eob"]): q["weight"] for q in pf.shrunk_optimum(scored, 20, 10, 0.3).collect()}
    close = np.array([[q[5] for q in of_day(rows, t, whole=False)] for t in range(40)])
    score = np.array([[q[2] for q in of_day(rows, t, whole=False)] for t in range(40)])
    r = np.vstack([np.full(7, np.nan), close[1:] / close[:-1] - 1])
    for t in (5, 12, 39):
        own = r[max(0, t - 19) : t + 1]
        own = own[~np.isnan(own).any(axis=1)]
        w = np.full(7, 1 / 7)
        if len(own) >= 10:
            cov = np.cov(own, rowvar=False)
            d = np.sqrt(np.diag(cov))
            raw = np.clip(np.linalg.solve((0.7 * cov / np.outer(d, d) + 0.3 * np.eye(7)) * np.outer(d, d), score[t]), 0, None)
            w = raw / raw.sum() if raw.sum() > 0 else w
        assert np.allclose([got[f"s{s}", day(t)] for s in range(7)], w)


def test_sampled_shares_near_the_exact_ones(spark):
    worth = [0.0, 1.0, 2.0, 5.0, 1.5, 2.0, 4.0, 9.0]
    exact = [0.0] * 3
    for order in itertools.permutations(range(3)):
        mask = 0
        for p in order:
            exact[p] += (worth[mask | 1 << p] - worth[mask]) / 6
            mask |= 1 << p
    got = {q["player"]: q["shapley"] for q in rs.permutation_shapley(spark, 3, worth.__getitem__, 2000, 4).collect()}
    again = {q["player"]: q["shapley"] for q in rs.permutation_shapley(spark, 3, worth.__getitem__, 2000, 4).collect()}
    assert got == pytest.approx(again) and all(abs(got[p] - exact[p]) < 0.1 for p in range(3)) and abs(sum(got.values()) - 9) < 1e-9
