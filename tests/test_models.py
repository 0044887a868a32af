"""Fitted models and series shapes against plain numpy."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import models as md
from barloom.operators import series as sr

KIND = "symbol string, eob timestamp_ntz, a double, b double, c double, y double"


def day(k):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(3)
    rows = []
    for t in range(60):
        for s in range(8):
            a, b, c = (r.normal(size=3) * (3, 1, 0.2)).tolist()
            rows.append((f"s{s}", day(t), a, b, a + 0.1 * c, None if t > 55 else 0.3 * a - 0.5 * b + 0.1 * float(r.normal())))
    rows.append(("s9", day(3), None, 1.0, 1.0, 1.0))
    return spark.createDataFrame(rows, KIND).repartition(5).cache(), [x for x in rows if x[2] is not None]


def test_lasso_meets_its_conditions():
    r = np.random.default_rng(0)
    for _ in range(20):
        x, y = r.normal(size=(40, 7)), r.normal(size=40)
        gram, cross, alpha = x.T @ x / 40, x.T @ y / 40, 0.02
        w = md.non_negative_lasso(gram, cross, alpha)
        slope = gram @ w - cross + alpha
        assert (w >= 0).all() and (slope > -1e-6).all() and (np.abs(slope[w > 0]) < 1e-6).all()


@pytest.mark.parametrize("rebalance", ["month", None])
def test_tracking_is_that_of_one_window_at_a_time(spark, monkeypatch, rebalance):
    monkeypatch.setattr(md, "SOLVES", 3)
    r = np.random.default_rng(5)
    x = r.normal(size=(150, 5)) * 0.01
    y = x @ [0.5, 0.3, 0.2, 0, 0] + r.normal(size=150) * 1e-4
    rows = [(f"s{j}", day(t), float(x[t, j])) for t in range(150) for j in range(5) if not (j == 1 and t == 70)]
    index = [(day(t), float(y[t])) for t in range(150)]
    out = md.lasso_track(spark.createDataFrame(rows, "symbol string, eob timestamp_ntz, ret double"), spark.createDataFrame(index, "eob timestamp_ntz, ret double"), 40, 1e-7, 20, rebalance, 0.4)
    got = {(q["symbol"], q["eob"]): q["weight"] for q in out.collect()}
    assert len(got) == len(rows)
    now = np.zeros(5)
    for t in range(150):
        if t >= 20 and (rebalance is None or t == 149 or day(t).month != day(t + 1).month):
            a = max(0, t - 40)
            whole = [j for j in range(5) if not (j == 1 and a <= 70 <= t)]
            own, n = x[a : t + 1][:, whole], t + 1 - a
            w = np.minimum(md.non_negative_lasso(own.T @ own / n, own.T @ y[a : t + 1] / n, 1e-7), 0.4)
            now = np.zeros(5)
            now[whole] = w / w.sum() if w.sum() > 0 else w
        for j in range(5):
            assert abs(got.get((f"s{j}", day(t)), now[j]) - now[j]) < 1e-5, (t, j)


def fold_rows(rows, f, least, step, purge, n):
    cut, end = least + f * step - purge, min(n, least + (f + 1) * step)
    train = [x for x in rows if x[5] is not None and x[1] < day(cut)]
    return train, [x for x in rows if day(least + f * step) <= x[1] < day(end)]


def test_components_are_those_of_each_fold_alone(spark, panel):
    df, rows = panel
    got = {(q["model"], q["symbol"], q["eob"]): q for q in md.expanding_components(df, ["a", "b", "c"], "y", 20, 9, 2, most=2).collect()}
    seen = 0
    for f in range(4):
        train, test = fold_rows(rows, f, 20, 9, 2, 56)  # labels end at day 55
        x, y = np.array([q[2:5] for q in train]), np.array([q[5] for q in train])
        m = x.mean(0)
        _, s, v = np.linalg.svd(x - m, full_matrices=False)
        z = (x - m) @ v[:2].T
        for model, alpha in (("ols", 0.0), ("lasso", 1e-3)):
            along = z.T @ (y - y.mean()) / len(y)
            beta = np.sign(along) * np.maximum(abs(along) - alpha, 0) / (z**2).mean(0)
            for q in test:
                out = got[model, q[0], q[1]]
                assert abs(out["score"] - (y.mean() + (np.array(q[2:5]) - m) @ v[:2].T @ beta)) < 1e-8 and out["fold"] == f
                assert abs(out["explained"] - (s[:2] ** 2).sum() / (s**2).sum()) < 1e-9
                seen += 1
    assert seen == len(got)


def test_scores_ignore_the_labels_of_their_own_fold(spark, panel):
    df, _ = panel
    other = df.withColumn("y", F.when(F.col("eob") >= day(38), -F.col("y")).otherwise(F.col("y")))
    scores = lambda rows: {(q["model"], q["symbol"], q["eob"]): round(q["score"], 9) for q in md.expanding_components(rows, ["a", "b", "c"], "y", 38, 18, 2, most=2, models=("ols", "gbt", "rf"), rounds=3).collect()}
    first = scores(df)
    assert first == scores(other) and {m for m, _, _ in first} == {"ols", "gbt", "rf"}
    with pytest.raises(ValueError):
        md.expanding_components(df, ["a"], "y", 20, 9, 2, models=("svm",))


def test_sweep_is_that_of_refits(spark, panel):
    df, rows = panel
    rows = [q for q in rows if q[5] is not None]
    got = {q["components"]: q for q in md.component_sweep(df, ["a", "b", "c"], "y", [1, 3], folds=4).collect()}
    days = sorted({q[1] for q in rows})
    block = {d: k for k, part in enumerate(np.array_split(np.arange(len(days)), 4)) for d in (days[i] for i in part)}
    for count in (1, 3):
        errors, spread = 0.0, 0.0
        for k in range(4):
            train, test = ([q for q in rows if (block[q[1]] == k) == own] for own in (False, True))
            x, y = np.array([q[2:5] for q in train]), np.array([q[5] for q in train])
            m, v = x.mean(0), np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:count].T
            beta = np.linalg.lstsq((x - m) @ v, y - y.mean(), rcond=None)[0]
            t = np.array([q[5] for q in test])
            errors += ((t - y.mean() - (np.array([q[2:5] for q in test]) - m) @ v @ beta) ** 2).sum()
            spread += ((t - t.mean()) ** 2).sum()
        assert abs(got[count]["mse"] - errors / len(rows)) < 1e-8 and abs(got[count]["r2"] - (1 - errors / spread)) < 1e-8


def test_metrics_of_scores(spark):
    rows = spark.createDataFrame([("m", s, day(t), float(v)) for t, vs in enumerate([(1, 2, 3), (3, 2, 1), (1, 1, 1)]) for s, v in zip("abc", vs, strict=True)], "model string, symbol string, eob timestamp_ntz, score double")
    labels = spark.createDataFrame([(s, day(t), float(v)) for t in range(3) for s, v in zip("abc", (1, 2, 4), strict=True)], "symbol string, eob timestamp_ntz, y double")
    out = md.score_metrics(rows, labels, "y").first()
    assert out["n"] == 9 and abs(out["rank_ic"]) < 1e-12 and abs(out["mse"] - (1 + 4 + 9 + 1 + 9) / 9) < 1e-12


def test_barriers_are_learned_before_the_split_only(spark, panel):
    df, _ = panel
    label = F.when(F.col("a") > 1, 1).when(F.col("a") < -1, -1).otherwise(0)
    rows = df.withColumn("label", label)
    after = F.col("eob") >= day(40)
    weights = lambda d: {(q["symbol"], q["eob"]): (q["weight"], round(q["up"], 9)) for q in md.barrier_weights(d, ["a", "b"], "label", "2020-02-10", rounds=5).collect()}
    got = weights(rows)
    assert got == weights(rows.withColumn("label", F.when(after, -label).otherwise(label)))
    truth = {(q["symbol"], q["eob"]): q["label"] for q in rows.collect()}
    assert np.mean([w == truth[k] for k, (w, _) in got.items()]) > 0.9 and min(e for _, e in got) == day(40)
    with pytest.raises(ValueError):
        md.barrier_weights(rows.withColumn("label", F.lit(1)), ["a"], "label", "2020-02-10")


def test_barriers_work_their_rows_out_once_and_do_not_depend_on_the_layout(spark, panel):
    df, kept = panel
    rows = df.withColumn("label", F.when(F.col("a") > 1, 1).when(F.col("b") < -1, -1).otherwise(0))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    weights = lambda d: {(q["symbol"], q["eob"]): (round(q["up"], 9), round(q["down"], 9), q["weight"]) for q in md.barrier_weights(d, ["a", "b"], "label", "2020-02-10", rounds=5).collect()}
    got = weights(rows.mapInArrow(counted, rows.schema))
    assert seen.value == len(kept) + 1  # with the row that misses a feature
    assert got == weights(rows.orderBy(F.desc("symbol")).coalesce(1)) == weights(rows.repartition(7, "c"))


def test_models_are_written_and_read_back(spark, panel, tmp_path):
    from barloom.sources import research_store

    df, _ = panel
    rows = md.assembled(df.dropna(), ["a", "b"]).withColumnRenamed("y", "label")
    model = md.GBTRegressor(maxIter=3, seed=1).fit(rows)
    made = md.save_model(model, str(tmp_path), "007", "gbt", ["a", "b"], {"r2": 0.5})
    meta = research_store.model_metadata(spark, str(tmp_path), "007", made)
    assert meta["features"] == ["a", "b"] and meta["namespace"] == "007"
    assert [r["model_id"] for r in research_store.list_models(spark, str(tmp_path), "007").collect()] == [made]
    again = md.predicted(md.load_model(str(tmp_path), "007", made), df, meta["features"])
    want = {(q["symbol"], q["eob"]): q["prediction"] for q in model.transform(md.assembled(df.dropna(subset=["a", "b"]), ["a", "b"])).collect()}
    assert {(q["symbol"], q["eob"]): q["prediction"] for q in again.collect()} == want


@pytest.mark.parametrize("window", [None, 25])
def test_learned_ranks_come_from_earlier_dates(spark, panel, window):
    df, _ = panel
    out = md.learned_factor(df, ["a", "b"], "y", train_share=0.6, window=window, step=15, rounds=3).collect()
    assert min(q["eob"] for q in out) == day(36 if window is None else 25) and all(0 < q["rank"] <= 1 for q in out)
    assert len(out) == 8 * (60 - (36 if window is None else 25))


# ---- series


def bars(spark, series):
    return spark.createDataFrame([(s, day(t), p) for s, ps in series.items() for t, p in enumerate(ps)], "symbol string, eob timestamp_ntz, close double").repartition(3)


def walk(n, seed):
    return np.exp(np.cumsum(np.random.default_rng(seed).normal(size=n) * 0.02)).tolist()


def test_binned_density_is_near_the_exact_one():
    for n in (20, 400, 5000):
        z = np.random.default_rng(n).standard_t(4, size=n)
        z = (z - z.mean()) / z.std(ddof=1)
        at = (z + 5) / (10 / (sr.GRID - 1) / sr.FINE)
        low = np.floor(at).astype(int)
        got = sr.binned_density(np.concatenate([low, low + 1]), np.concatenate([1 - (at - low), at - low]), n)
        x, h = np.linspace(-5, 5, sr.GRID), n**-0.2
        want = np.exp(-0.5 * ((x[:, None] - z) / h) ** 2).sum(1) / (n * h * math.sqrt(2 * math.pi))
        assert np.abs(got - want).max() < 1e-5


def test_peaks():
    assert sr.peaks(np.array([0, 1, 0, 2, 2, 0, 0.005, 0, 3.0])) == 2 and sr.peaks(np.zeros(5)) == 0 and sr.peaks(np.array([1.0, 2, 3])) == 0


def test_densities_leave_out_bad_prices(spark):
    p = walk(60, 1)
    both = {"clean": p, "holes": [p[0], None, *p[1:30], 0.0, -1.0, *p[30:]], "flat": [1.0] * 40, "short": [1.0, 2.0]}
    out = {(q["symbol"], q["lag"]): q for q in sr.density_shapes(bars(spark, both), lags=(1, 3)).collect()}
    assert {s for s, _ in out} == {"clean", "holes"}
    assert all(out["clean", k]["peak_height"] == out["holes", k]["peak_height"] and out["clean", k]["n"] == 60 - k for k in (1, 3))


def exponent(p, low=10, high=100):
    p = np.array([v for v in p if v is not None and v > 0])
    r, most = np.diff(np.log(p)), min(high, len(p) // 2)
    if most < low or len(r) <= most:
        return None
    points = []
    for lag in range(low, most + 1):
        rs = []
        for i in range(len(r) - lag + 1):
            w = r[i : i + lag]
            c = np.cumsum(w - w.mean())
            if w.std(ddof=1) > 1e-14:
                rs.append((c.max() - c.min()) / w.std(ddof=1))
        if rs:
            points.append((math.log(lag), math.log(np.mean(rs))))
    return float(np.polyfit(*zip(*points, strict=True), 1)[0]) if len(points) >= 3 else None


def test_exponents_are_those_of_all_windows(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # windows reach over batches
    try:
        p = walk(150, 2)
        both = {"long": walk(260, 1), "holes": [*p[:50], None, 0.0, *p[50:]], "short": walk(15, 3), "few": walk(23, 4), "flat": [2.0] * 50}
        out = {q["symbol"]: q for q in sr.hurst(bars(spark, both)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for s, ps in both.items():
        want = exponent(ps)
        assert (out[s]["hurst"] is None) == (want is None) and (want is None or abs(out[s]["hurst"] - want) < 1e-9), s


def test_recent_windows_are_series_of_their_own(spark):
    p = walk(70, 6)
    out = {(q["symbol"], q["window"]): q for q in sr.recent_windows(bars(spark, {"x": p}), (20, 40)).collect()}
    assert set(out) == {("x", 20), ("x", 40)}
    assert abs(out["x", 40]["hurst"] - exponent(p[-40:], 6, 13)) < 1e-9 and out["x", 40]["n_obs"] == 40
    assert sr.recent_windows(bars(spark, {"x": walk(500, 1)}), (30,), by_year=True).select("year").distinct().count() == 2
