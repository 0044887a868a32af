"""Fitted models of panels: tracking portfolios, principal components and regressions on expanding folds, trees, a model registry.

Linear models never reread their training rows: a date's rows become sums of products once, and each fold adds
up the sums of its dates. Trees are Spark ML's, trained on the cluster once a fold.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.windows import dates, percent_rank
from barloom.session import cut

# ---- sparse index tracking

#: Rebalance dates that one task solves; it keeps the Gram matrix of their running window.
SOLVES = 64


def non_negative_lasso(gram: np.ndarray, cross: np.ndarray, alpha: float, start: np.ndarray | None = None, rounds: int = 5000, tolerance: float = 1e-12) -> np.ndarray:
    """The w >= 0 that minimises w' gram w / 2 - cross w + alpha sum(w), by cyclic coordinate descent."""
    w = np.zeros(len(cross)) if start is None else start.copy()
    rest = cross - gram @ w
    for _ in range(rounds):
        most = 0.0
        for j in np.flatnonzero(np.diag(gram) > 0):
            new = max(0.0, w[j] + (rest[j] - alpha) / gram[j, j])
            if new != w[j]:
                rest -= gram[:, j] * (new - w[j])
                most = max(most, gram[j, j] * (new - w[j]) ** 2)
                w[j] = new
        if most <= tolerance * max(float(cross @ w), 1e-300):
            break
    return w


def lasso_track(df: DataFrame, index: DataFrame, lookback: int = 120, alpha: float = 1e-6, least: int = 60, rebalance: str | None = "month", cap: float = 0.3) -> DataFrame:
    """Weights of few symbols that track an index: symbol, eob, weight for every row on a date that both sides have.

    df: symbol, eob, ret; index: eob, ret. On the last date of every `rebalance` period (week, month; None: every
    date) past the first `least` dates, a non-negative L1 regression over the last `lookback` + 1 dates is
    solved; weights are capped, then brought to sum 1, and hold until the next solve; before the first they are 0. Symbols with a return
    missing in the window have no part in it; a window with fewer than two whole symbols is passed over.

    Dates are numbered once; each run of SOLVES rebalance dates gets its rows and those of the windows before
    them, and a task moves one Gram matrix along by the dates that come and go.
    """
    days = index.where("ret IS NOT NULL").join(df.select("eob").distinct(), "eob").groupBy("eob").agg(F.avg("ret").alias("index_"))
    place = F.row_number().over(dates()) - 1
    period = F.col("eob") if rebalance is None else F.date_trunc(rebalance, "eob")
    last = F.lead(period).over(dates()).isNull() | (F.lead(period).over(dates()) != period)
    days = days.select("eob", "index_", place.alias("t"), (last if rebalance else F.lit(True)).alias("last"))
    days = days.withColumn("solve", F.col("last") & (F.col("t") >= least))
    days = days.withColumn("run", F.floor((F.sum(F.col("solve").cast("int")).over(dates()) - 1) / SOLVES))
    runs = days.where("solve").groupBy("run").agg((F.min("t") - lookback).alias("a"), F.max("t").alias("b"), F.sort_array(F.collect_list("t")).alias("solves"))
    times = runs.select("run", "solves", F.explode(F.sequence(F.greatest("a", F.lit(0)), F.col("b"))).alias("t"))
    rows = cut(days.join(df.select("symbol", "eob", "ret"), "eob").select("symbol", "eob", "t", "ret", "index_"))
    dealt = rows.join(times, "t").select("run", "solves", "symbol", "t", "ret", "index_")

    def solved(part: pa.Table) -> pa.Table:
        symbols, times = sorted(set(part.column("symbol").to_pylist())), np.unique(part.column("t").to_numpy())
        where = {s: i for i, s in enumerate(symbols)}
        x, y = np.full((len(times), len(symbols)), np.nan), np.zeros(len(times))
        at = np.searchsorted(times, part.column("t").to_numpy())
        x[at, np.fromiter((where[s] for s in part.column("symbol").to_pylist()), int, part.num_rows)] = part.column("ret").to_numpy(zero_copy_only=False)
        y[at] = part.column("index_").to_numpy()
        clean, gone = np.nan_to_num(x), np.isnan(x)
        gram, cross, missing, low, high, out = np.zeros((len(symbols),) * 2), np.zeros(len(symbols)), np.zeros(len(symbols), int), 0, 0, []
        for t in part.column("solves")[0].as_py():
            a, b = np.searchsorted(times, [t - lookback, t + 1])
            for sign, begin, end in ((1, high, b), (-1, low, a)):
                own = clean[begin:end]
                gram, cross, missing = gram + sign * own.T @ own, cross + sign * own.T @ y[begin:end], missing + sign * gone[begin:end].sum(axis=0)
            low, high, whole = a, b, np.flatnonzero(missing == 0)
            if len(whole) < 2 or b - a < least:
                continue
            w = np.minimum(non_negative_lasso(gram[np.ix_(whole, whole)] / (b - a), cross[whole] / (b - a), alpha), cap)
            w = w / w.sum() if w.sum() > 0 else w
            out += [(t, symbols[k], float(v)) for k, v in zip(whole, w, strict=True) if v > 0] or [(t, symbols[whole[0]], 0.0)]
        return pa.table({"t": pa.array([o[0] for o in out], pa.int32()), "symbol": pa.array([o[1] for o in out], pa.string()), "weight": pa.array([o[2] for o in out], pa.float64())})

    weights = dealt.groupBy("run").applyInArrow(solved, "t int, symbol string, weight double")
    solves = weights.select("t").distinct().withColumnRenamed("t", "held")
    # one row a date: the last solve at or before it
    held = days.join(solves, F.col("t") == F.col("held"), "left").select("eob", F.last("held", ignorenulls=True).over(dates().rowsBetween(Window.unboundedPreceding, 0)).alias("held"))
    grid = rows.select("symbol", "eob").join(held, "eob")
    return grid.join(weights.withColumnRenamed("t", "held"), ["held", "symbol"], "left").select("symbol", "eob", F.coalesce("weight", F.lit(0.0)).alias("weight"))


# ---- sums of products on expanding folds


def moment_sums(df: DataFrame, features: list[str], label: str, by: list[str]) -> DataFrame:
    """Sums of products of (1, features, label) over the whole rows of each group `by`: one row for each of them, numbered by `k` of the upper triangle.

    The rows of a date are summed in Arrow batches where they lie, so only sums are shuffled.
    """
    wide, names = len(features) + 2, [*features, label]
    upper = np.triu_indices(wide)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names)])
            keys = pa.Table.from_batches([batch.select(by)]).append_column("i", pa.array(np.arange(batch.num_rows)))
            groups = keys.group_by(by, use_threads=False).aggregate([("i", "list")])
            for g in range(groups.num_rows):
                own = x[groups.column("i_list")[g].values.to_numpy()]
                sums = (own.T @ own)[upper]
                sides = [pa.array([groups.column(c)[g].as_py()] * len(sums), groups.schema.field(c).type) for c in by]
                yield pa.RecordBatch.from_arrays([*sides, pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], [*by, "k", "v"])

    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in names]).dropna()
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", k int, v double"
    return rows.sortWithinPartitions(*by).mapInArrow(run, schema).groupBy(*by, "k").agg(F.sum("v").alias("v"))


def square(values: list[float], wide: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    out = np.zeros((wide, wide))
    out[np.triu_indices(wide)] = values
    return out + np.triu(out, 1).T


def components_of(products: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, components (columns), variances and the share of all variance, from sums of products of (1, features, label)."""
    n, sums, p = products[0, 0], products[0, 1:-1], len(products) - 2
    mean = sums / n
    values, vectors = np.linalg.eigh((products[1:-1, 1:-1] - n * np.outer(mean, mean)) / n)
    order = np.argsort(-values)[: min(most, p, int(n))]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(len(order))] < 0, -1.0, 1.0)  # the heaviest loading is positive
    whole = max(float(values.clip(0).sum()), 1e-300)
    return mean, vectors, values[order].clip(0), float(values[order].clip(0).sum()) / whole


def component_regression(products: np.ndarray, most: int, alpha: float) -> tuple[np.ndarray, float, int, float]:
    """Feature weights, intercept, non-zero coefficients and explained share of a regression on principal components, L1-penalised by `alpha`.

    Components are uncorrelated over the rows they come from, so each coefficient is its own soft threshold.
    """
    mean, vectors, variances, share = components_of(products, most)
    n = products[0, 0]
    level = products[0, -1] / n
    along = vectors.T @ (products[1:-1, -1] / n - mean * level)
    shrunk = np.sign(along) * np.maximum(np.abs(along) - alpha, 0.0)
    beta = np.where(variances > 1e-12 * max(variances.max(initial=0), 1e-300), shrunk / np.maximum(variances, 1e-300), 0.0)
    weights = vectors @ beta
    return weights, float(level - mean @ weights), int(np.count_nonzero(beta)), share


LINEAR = {"ols": 0.0, "lasso": 1e-3}


def fold_calendar(df: DataFrame, label: str, least: int, step: int, purge: int) -> DataFrame:
    """Every labelled date with its place, the fold that it is a test date of (null before the first) and the first fold that trains on it."""
    days = df.where(F.col(label).isNotNull()).select("eob").distinct().withColumn("place", F.row_number().over(dates()) - 1)
    tested = F.when(F.col("place") >= least, F.floor((F.col("place") - least) / step)).cast("int")
    joins = F.greatest(F.lit(0), F.ceil((F.col("place") + purge + 1 - least) / step)).cast("int")
    return days.withColumns({"fold": tested, "joins": joins})


def fold_sums(df: DataFrame, features: list[str], label: str, calendar: DataFrame) -> DataFrame:
    """fold, products: the sums of products of each test fold's training rows, which are those of all dates that joined by then."""
    own = moment_sums(df.join(calendar.select("eob", "joins"), "eob"), features, label, ["joins"])
    sums = own.withColumn("v", F.sum("v").over(Window.partitionBy("k").orderBy("joins").rowsBetween(Window.unboundedPreceding, 0)))
    # of each fold the last group of dates that has joined: one row a fold or a group
    folds = calendar.where("fold IS NOT NULL").select("fold", F.lit(None).cast("int").alias("joins")).distinct()
    marks = folds.unionByName(calendar.select(F.col("joins").alias("fold"), "joins").distinct())
    order = Window.orderBy("fold", F.col("joins").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.select("fold", F.col("joins").isNull().alias("asked"), F.last("joins", ignorenulls=True).over(order).alias("joins")).where("asked")
    return marks.join(sums, "joins").groupBy("fold").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("products"))


def expanding_components(df: DataFrame, features: list[str], label: str, least: int, step: int, purge: int, most: int = 50, models: tuple[str, ...] = ("ols", "lasso"), rounds: int = 80, seed: int = 42) -> DataFrame:
    """Walk-forward scores of several models on principal components fitted on each fold's training rows alone.

    Folds: from the `least`-th labelled date on, every `step` dates are a test fold; it trains on all labelled
    rows up to `purge` dates before it. `ols` and `lasso` come from running sums of products; `rf` and `gbt` are
    Spark ML's forests and boosted trees, trained on the fold's rows turned by its components. Rows with a missing feature are
    left out; rows of a test date without a label are scored too. A fold without training rows gives no scores. The universe's features per date
    are summed where they lie; the driver sees folds, never rows. Returns symbol, eob, model, fold, score, explained, used (non-zero coefficients; null for trees).
    """
    unknown = set(models) - {*LINEAR, "rf", "gbt"}
    if unknown or not models:
        raise ValueError(f"unknown models: {sorted(unknown)}" if unknown else "no models asked for")
    rows = cut(df.select("symbol", "eob", *features, label).dropna(subset=features))  # the sums, the folds and the scores read these rows
    calendar = fold_calendar(rows, label, least, step, purge)
    sums = fold_sums(rows, features, label, calendar)
    wide, kinds = len(features) + 2, [m for m in models if m in LINEAR]

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for fold, products in zip(batch.column("fold").to_pylist(), batch.column("products").to_pylist(), strict=True):
                whole = square(products, wide)
                if whole[0, 0] < 1:
                    continue
                mean, vectors, _, share = components_of(whole, most)
                for model in kinds:
                    weights, level, used, _ = component_regression(whole, most, LINEAR[model])
                    out.append((fold, model, weights.tolist(), level, used, share, None, None))
                out.append((fold, "components", None, None, None, share, mean.tolist(), vectors.T.tolist()))
            types = [pa.int32(), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64()))]
            names = ["fold", "model", "weights", "level", "used", "explained", "mean", "components"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], k) for k in types], names)

    fitted = sums.mapInArrow(solved, "fold int, model string, weights array<double>, level double, used int, explained double, mean array<double>, components array<array<double>>")
    tested = rows.join(calendar.where("fold IS NOT NULL").select("eob", "fold"), "eob").withColumn("x_", F.array(*[F.col(f).cast("double") for f in features]))
    score = F.col("level") + F.aggregate(F.zip_with("x_", "weights", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    scored = tested.join(fitted.where(F.col("model") != "components"), "fold").select("symbol", "eob", "model", "fold", score.alias("score"), "explained", "used")
    if "rf" not in models and "gbt" not in models:
        return scored
    turn = F.transform("components", lambda v: F.aggregate(F.zip_with(F.zip_with("x_", "mean", lambda a, m: a - m), v, lambda a, b: a * b), F.lit(0.0), lambda a, s: a + s))
    for row in fitted.where("model = 'components'").select("fold", "explained", "mean", "components").orderBy("fold").collect():  # folds, not rows
        own = lambda part, row=row: part.withColumns({"mean": F.lit(row["mean"]).cast("array<double>"), "components": F.array(*[F.lit(c).cast("array<double>") for c in row["components"]])}).withColumn("features", array_to_vector(turn))
        train = rows.join(calendar.where(F.col("joins") <= row["fold"]).select("eob"), "eob").where(F.col(label).isNotNull()).withColumn("x_", F.array(*[F.col(f).cast("double") for f in features]))
        train = own(train).select("features", F.col(label).cast("double").alias("label"))
        for model in [m for m in models if m not in LINEAR]:
            machine = (
                RandomForestRegressor(numTrees=max(1, rounds), maxDepth=6, minInstancesPerNode=5, seed=seed) if model == "rf"
                else GBTRegressor(maxIter=rounds, maxDepth=2, stepSize=0.05, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed)
            ).fit(train)
            test = machine.transform(own(tested.where(F.col("fold") == row["fold"])))
            part = test.select("symbol", "eob", F.lit(model).alias("model"), "fold", F.col("prediction").alias("score"), F.lit(row["explained"]).alias("explained"), F.lit(None).cast("int").alias("used"))
            scored = scored.unionByName(part)
    return scored


def score_metrics(scored: DataFrame, labels: DataFrame, label: str, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean squared error, its root, r2 over the labelled rows, and the mean of the daily rank correlations, of each group of scores."""
    both = scored.join(labels.select("symbol", "eob", F.col(label).alias("y_")), ["symbol", "eob"]).where("y_ IS NOT NULL AND score IS NOT NULL")
    both = cut(both.select(*by, "eob", "score", "y_"))  # errors and ranks
    off = F.col("score") - F.col("y_")
    errors = both.groupBy(*by).agg(
        F.avg(off * off).alias("mse"), F.sqrt(F.avg(off * off)).alias("rmse"), F.when(F.var_pop("y_") > 0, 1 - F.avg(off * off) / F.var_pop("y_")).alias("r2"), F.count("*").alias("n"),
    )
    key = (*by, "eob")
    ranks = both.withColumns({"a_": percent_rank("score", key), "b_": percent_rank("y_", key)})
    both_vary = F.try_divide(F.covar_pop("a_", "b_"), F.stddev_pop("a_") * F.stddev_pop("b_"))
    daily = ranks.groupBy(*key).agg(F.when(F.count("*") >= 2, both_vary).alias("ic"))
    return errors.join(daily.groupBy(*by).agg(F.avg("ic").alias("rank_ic")), list(by))


def component_sweep(df: DataFrame, features: list[str], label: str, counts: list[int], folds: int = 5, alpha: float = 0.0) -> DataFrame:
    """Cross-validated error and r2 of a regression on the first 1, 2, .. components: one row for each of `counts`.

    Consecutive blocks of dates are the folds. Sums of products of each block are all that is needed to fit on
    the others and to judge on it, so the rows are read once whatever the number of counts.
    """
    rows = df.dropna(subset=[*features, label])
    days = rows.select("eob").distinct().withColumn("block", (F.ntile(folds).over(dates()) - 1).cast("int"))
    wide = len(features) + 2
    sums = moment_sums(rows.join(days, "eob"), features, label, ["block"])
    held = {r["block"]: square(r["v"], wide) for r in sums.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("v")).collect()}  # `folds` small matrices
    whole, out = sum(held.values()), []
    for count in counts:
        errors, spread, n = 0.0, 0.0, 0.0
        for own in held.values():
            train = whole - own
            if train[0, 0] < 1:
                continue
            weights, level, _, _ = component_regression(train, count, alpha)
            w = np.concatenate([[-level], -weights, [1.0]])  # label less score
            errors, n = errors + float(w @ own @ w), n + own[0, 0]
            spread += float(own[-1, -1] - own[0, -1] ** 2 / own[0, 0])
        out.append((count, float(errors / n) if n else None, float(1 - errors / spread) if spread else None, int(n)))
    return df.sparkSession.createDataFrame(out, "components int, mse double, r2 double, n long")


# ---- trees and their weights


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


#: Rows that a partition of the boosted classifiers' training rows has, about.
TRAIN_ROWS = 250_000


def barrier_weights(df: DataFrame, features: list[str], label: str, split: str, purge: int = 5, threshold: float = 0.15, rounds: int = 50, seed: int = 7) -> DataFrame:
    """Weights 1, -1 or 0 on the dates from `split` on, by the chance of an upper barrier less that of a lower one.

    Two boosted classifiers (a label of 1 against others, and -1 against others) are trained on the rows before
    `split` but the last `purge` dates, whose labels reach beyond it. Labels are -1, 0 or 1; both outer ones must occur, rows
    with a missing feature take no part. `df` is worked out once. Returns symbol, eob, up, down, weight.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    rows = assembled(cut(df.select("symbol", "eob", *features, label).dropna(subset=features)), features)  # dates, labels, both models and the test read them
    before = F.col("eob") < F.lit(split).cast("timestamp_ntz")
    days = rows.where(before & F.col(label).isNotNull()).select("eob").distinct().withColumn("back", F.row_number().over(Window.orderBy(F.desc("eob")))).where(F.col("back") > purge)
    train = rows.where(F.col(label).isNotNull()).join(days.select("eob"), "eob").select("symbol", "eob", "features", F.col(label).cast("int").alias("y_"))
    seen = {r["y_"]: r["count"] for r in train.groupBy("y_").count().collect()}
    if not {-1, 1} <= seen.keys() or seen.keys() - {-1, 0, 1}:
        raise ValueError(f"labels -1 and 1 must occur before {split}, and none but -1, 0, 1: {sorted(seen)}")
    # Spark ML draws a round's rows by partition and place: dealt by key and in order, they are the same whatever the cluster
    train = train.repartition(8 + sum(seen.values()) // TRAIN_ROWS, "eob", "symbol").sortWithinPartitions("eob", "symbol")
    test = rows.where(~before).select("symbol", "eob", "features")
    for name, side in (("up", 1), ("down", -1)):
        machine = GBTClassifier(maxIter=rounds, maxDepth=2, stepSize=0.05, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed)
        machine = machine.setProbabilityCol("p_").setRawPredictionCol("r_").setPredictionCol("q_")
        test = machine.fit(train.select("features", (F.col("y_") == side).cast("double").alias("label"))).transform(test).withColumn(name, vector_to_array("p_")[1]).drop("p_", "r_", "q_")
    spread = F.col("up") - F.col("down")
    return test.select("symbol", "eob", "up", "down", F.when(spread > threshold, 1.0).when(spread < -threshold, -1.0).otherwise(0.0).alias("weight"))


def learned_factor(df: DataFrame, features: list[str], label: str, train_share: float = 0.7, window: int | None = None, step: int = 20, purge: int = 1, rounds: int = 20, seed: int = 42) -> DataFrame:
    """The cross-sectional percent rank of a boosted model's predictions on dates outside its training: symbol, eob, fold, prediction, rank.

    Fixed (`window` None): trained once on the first `train_share` of the dates. Rolling: before every `step` test
    dates on the last `window` dates. The last `purge` dates before a test are left out, as their labels reach into it.
    """
    rows = assembled(cut(df.select("symbol", "eob", *features, label).dropna(subset=features)), features)  # every fold reads them
    days = rows.select("eob").distinct().withColumn("place", F.row_number().over(dates()) - 1)
    n, out = days.count(), None
    first = int(n * train_share) if window is None else window
    for fold, begin in enumerate([first] if window is None else range(first, n, step)):
        end = n if window is None else begin + step
        own = (F.col("place") < begin - purge) & (F.col("place") >= (0 if window is None else begin - window))
        train = rows.where(F.col(label).isNotNull()).join(days.where(own).select("eob"), "eob").select("features", F.col(label).cast("double").alias("label"))
        if train.isEmpty():
            continue
        machine = GBTRegressor(maxIter=rounds, maxDepth=2, stepSize=0.1, seed=seed).fit(train)
        part = machine.transform(rows.join(days.where((F.col("place") >= begin) & (F.col("place") < end)).select("eob"), "eob")).select("symbol", "eob", F.lit(fold).alias("fold"), "prediction")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no date has training rows before it")
    return out.withColumn("rank", percent_rank("prediction"))


# ---- registry


def save_model(model: Any, root: str, namespace: str, name: str, features: list[str], metrics: dict[str, float] | None = None, task: str = "regression", **more: Any) -> str:
    """Write a fitted Spark ML model with its metadata under root/models/namespace and return its id."""
    from barloom.sources.research_store import _at

    now = datetime.now(timezone.utc)
    spark, made = SparkSession.getActiveSession(), f"{task}_{name}_{now:%Y%m%d_%H%M%S_%f}"
    meta = {"model_id": made, "namespace": namespace, "task": task, "model_name": name, "features": features, "metrics": metrics or {}, "created_at": now.isoformat(), "class": type(model).__name__} | more
    path = _at(root, "models", namespace, made)
    (model if isinstance(model, PipelineModel) else PipelineModel([model])).write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata.json")
    return made


def load_model(root: str, namespace: str, model: str) -> PipelineModel:
    from barloom.sources.research_store import _at

    return PipelineModel.load(_at(root, "models", namespace, model) + "/model")


def predicted(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """The rows whose features are all there, with the model's prediction."""
    whole = rows.dropna(subset=features)
    return model.transform(assembled(whole, features)).drop("features", "rawPrediction", "probability")
