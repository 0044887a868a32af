"""Research statistics: folds, sweeps, screening, overfitting measures, regression attribution, walk-forward models."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.indicators import INDICATORS
from barloom.functions.windows import by_date, dates, percent_rank
from barloom.operators.cross_section import forward_return, rank_ic, summarize_ic


def expanding_folds(days: DataFrame, least: int, step: int, purge: int) -> DataFrame:
    """Train end and test range, as positions in the calendar, of expanding folds; the last `purge` dates before a test go.

    days: one row a date, column eob.
    """
    places = days.select("eob", (F.row_number().over(dates()) - 1).alias("place"))
    fold = F.floor((F.col("place") - least) / step).cast("int")
    tests = places.where(F.col("place") >= least).withColumn("fold", fold)
    return tests.groupBy("fold").agg(F.min("eob").alias("test_start"), F.max("eob").alias("test_end"), F.count("*").alias("test_days"), (F.min("place") - purge).cast("bigint").alias("train_days"))


def unfolded(bars: DataFrame, columns: dict, key: str, horizon: int, least: int) -> DataFrame:
    """Summaries of daily rank ICs of several columns: label -> a function that adds `value` to the bars.

    The functions run one behind the other on the same rows, so those that are windows share one sort; then each row is unfolded.
    """
    wide, names = bars.withColumn("ahead_of_all", forward_return("close", horizon)), {}
    for i, (label, add) in enumerate(columns.items()):
        names[label] = f"value_{i}_of_all"
        wide = add(wide).withColumnRenamed("value", names[label])
    cells = F.array(*[F.struct(F.lit(label).alias(key), F.col(n).cast("double").alias("value")) for label, n in names.items()])
    long = wide.select("eob", F.col("ahead_of_all").alias("fwd"), F.explode(cells).alias("c")).select("eob", "fwd", "c.*")
    return summarize_ic(rank_ic(long, "value", "fwd", least, (key, "eob")), (key,))


def screen(bars: DataFrame, names: list[str], horizon: int = 1, least: int = 5) -> DataFrame:
    """Daily rank IC summary of each named indicator: one scan and one plan for all of them."""
    return unfolded(bars, {n: INDICATORS[n] for n in names}, "indicator", horizon, least)


def sweep(bars: DataFrame, name: str, parameter: str, values: list, horizon: int = 1, least: int = 5) -> DataFrame:
    """The same for one indicator over values of one parameter."""
    return unfolded(bars, {v: lambda df, v=v: INDICATORS[name](df, **{parameter: v}) for v in values}, parameter, horizon, least)


def rolling_metrics(daily: DataFrame, x: str, windows: tuple[int, ...], year: int = 252) -> DataFrame:
    """Mean and extremes, over all windows of each length, of the rolling Sharpe ratio and return of a dated series."""
    out = None
    for n in windows:
        frame = dates().rowsBetween(-(n - 1), 0)
        mean, std = F.avg(x).over(frame), F.stddev_samp(x).over(frame)
        part = daily.select(F.lit(n).alias("window"), F.when(F.count(x).over(frame) >= n, F.try_divide(mean, std) * math.sqrt(year)).alias("sharpe"), F.when(F.count(x).over(frame) >= n, mean * year).alias("ret"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("window").agg(F.avg("sharpe").alias("sharpe_mean"), F.min("sharpe").alias("sharpe_min"), F.max("sharpe").alias("sharpe_max"), F.avg("ret").alias("return_mean"), F.count("sharpe").alias("n"))


def deflated_sharpe(daily: DataFrame, x: str, trials: int) -> DataFrame:
    """Probability that the Sharpe ratio is above what the best of `trials` worthless ones would show.

    Spark sums the moments; the normal distribution's functions run on one row of five numbers.
    """
    m = daily.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.skewness(x).alias("g"), F.kurtosis(x).alias("k"), F.count(x).alias("n")).first()
    spark, normal = daily.sparkSession, NormalDist()
    kind = "sharpe double, threshold double, probability double"
    if not m["n"] or m["n"] < 2 or not m["s"]:
        return spark.createDataFrame([(None, None, None)], kind)
    sharpe, n = m["m"] / m["s"], m["n"]
    euler = 0.5772156649015329
    top = (1 - euler) * normal.inv_cdf(1 - 1 / trials) + euler * normal.inv_cdf(1 - 1 / (trials * math.e)) if trials > 1 else 0.0
    spread = math.sqrt((1 - m["g"] * sharpe + (m["k"] + 2) / 4 * sharpe**2) / (n - 1))
    threshold = top / math.sqrt(n - 1)
    return spark.createDataFrame([(sharpe, threshold, normal.cdf((sharpe - threshold) / spread))], kind)


def overfitting(candidates: DataFrame, splits: int) -> DataFrame:
    """Combinatorial cross-validation: for each half of the date blocks, the best candidate inside and its rank outside.

    candidates: candidate, eob, ret. Spark sums each (block, candidate) once; each combination is then a
    few sums of those, spread over the cluster as rows.
    """
    days = candidates.select("eob").distinct().withColumn("block", F.ntile(splits).over(dates()) - 1)
    cells = candidates.join(F.broadcast(days), "eob").groupBy("candidate", "block").agg(F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"), F.count("*").alias("n"))
    halves = [(i, list(h)) for i, h in enumerate(itertools.combinations(range(splits), splits // 2))]
    combos = candidates.sparkSession.createDataFrame(halves, "combination int, inside array<int>")
    both = cells.join(F.broadcast(combos)).withColumn("within", F.array_contains("inside", F.col("block")))
    sums = both.groupBy("combination", "candidate", "within").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    mean = F.col("s") / F.col("n")
    sums = sums.withColumn("sharpe", F.try_divide(mean, F.sqrt(F.col("q") / F.col("n") - mean * mean)))
    wide = sums.groupBy("combination", "candidate").agg(F.max(F.when(F.col("within"), F.col("sharpe"))).alias("inside"), F.max(F.when(~F.col("within"), F.col("sharpe"))).alias("outside"))
    group = Window.partitionBy("combination")
    ranked = wide.withColumn("place", F.row_number().over(group.orderBy(F.desc("inside"), "candidate"))).withColumn("rank", F.rank().over(group.orderBy("outside")) / (F.count("*").over(group) + 1))
    return ranked.where("place = 1").select("combination", F.col("candidate").alias("best"), F.col("rank").alias("outside_rank"), F.log(F.col("rank") / (1 - F.col("rank"))).alias("logit"))


def regression_attribution(df: DataFrame, factors: list[str], target: str, ridge: float = 1e-3) -> DataFrame:
    """Ridge coefficients of a date's returns on its z-scored factors; one date is one small group."""
    names = list(factors)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.dropna(subset=[*names, target]).sort_values("symbol")
        if len(rows) <= len(names) + 1:
            return pd.DataFrame({"eob": pd.Series(dtype=object), "term": pd.Series(dtype=object), "beta": pd.Series(dtype=float)})
        x = rows[names].to_numpy(float)
        x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        x = np.column_stack([np.ones(len(x)), x])
        penalty = ridge * np.eye(x.shape[1])
        penalty[0, 0] = 0.0
        beta = np.linalg.solve(x.T @ x + penalty, x.T @ rows[target].to_numpy(float))
        return pd.DataFrame({"eob": part["eob"].iloc[0], "term": ["intercept", *names], "beta": beta})

    return df.select("symbol", "eob", *names, target).groupBy("eob").applyInPandas(solve, f"eob {dict(df.dtypes)['eob']}, term string, beta double")


def walk_forward(df: DataFrame, features: list[str], label: str, least: int, step: int, purge: int, ridge: float = 1e-3) -> DataFrame:
    """Scores of each test date by a ridge regression on all earlier dates but the purged ones.

    The normal equations are sums over dates, so Spark adds them up once per date and a running window
    gives every fold's sums; no fold rereads its training rows, and a solve is of the features' size.
    """
    k = len(features)
    rows = df.dropna(subset=features).withColumns({f"z_{f}": percent_rank(f) - 0.5 for f in features})
    x = [F.lit(1.0), *[F.col(f"z_{f}") for f in features]]
    terms = [F.sum(F.when(F.col(label).isNotNull(), a * b)).alias(f"a{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if j >= i]
    terms += [F.sum(a * F.col(label)).alias(f"b{i}") for i, a in enumerate(x)]
    daily = rows.groupBy("eob").agg(*terms).withColumn("place", F.row_number().over(dates()) - 1)
    before = Window.orderBy("place").rangeBetween(Window.unboundedPreceding, -purge - 1)
    names = [c for c in daily.columns if c not in ("eob", "place")]
    sums = daily.select("eob", "place", *[F.sum(c).over(before).alias(c) for c in names])
    starts = sums.where((F.col("place") >= least) & ((F.col("place") - least) % step == 0)).withColumn("fold", F.floor((F.col("place") - least) / step).cast("int")).drop("eob", "place")

    def solve(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                a = np.zeros((k + 1, k + 1))
                for i in range(k + 1):
                    for j in range(i, k + 1):
                        a[i, j] = a[j, i] = row[f"a{i}_{j}"]
                out.append(np.linalg.solve(a + ridge * np.eye(k + 1), np.array([row[f"b{i}"] for i in range(k + 1)])).tolist())
            yield pd.DataFrame({"fold": frame["fold"], "beta": out})

    betas = starts.mapInPandas(solve, "fold int, beta array<double>")
    calendar = daily.select("eob", "place").where(F.col("place") >= least).withColumn("fold", F.floor((F.col("place") - least) / step).cast("int"))
    scored = rows.join(F.broadcast(calendar), "eob").join(F.broadcast(betas), "fold")
    score = F.get("beta", F.lit(0)) + sum((F.get("beta", F.lit(i + 1)) * F.col(f"z_{f}") for i, f in enumerate(features)), F.lit(0.0))
    return scored.select("symbol", "eob", "fold", score.alias("score"))


def permutation_shapley(spark, players: int, value: Callable[[int], float], permutations: int, seed: int) -> DataFrame:
    """Sampled Shapley values; permutations are rows with seeds of their own, so tasks may be run again anywhere."""

    def draw(frames):
        for frame in frames:
            out = []
            for i in frame["id"]:
                mask, last = 0, value(0)
                for p in np.random.default_rng([seed, int(i)]).permutation(players):
                    mask |= 1 << int(p)
                    now = value(mask)
                    out.append((int(p), now - last))
                    last = now
            yield pd.DataFrame(out, columns=["player", "gain"])

    return spark.range(permutations).mapInPandas(draw, "player int, gain double").groupBy("player").agg(F.avg("gain").alias("shapley"))


def neutral_score(df: DataFrame, x: str, category: str = "category") -> DataFrame:
    """x less its category's mean on each date."""
    return df.withColumn("value", F.col(x) - F.avg(x).over(by_date().partitionBy("eob", category)))


def purged_folds(days: DataFrame, folds: int, purge: int, embargo: int) -> DataFrame:
    """Days of test and training of each of the consecutive folds of a calendar.

    Training loses `purge` days on either side of a test and `embargo` more behind it. days: one row a date.
    """
    whole = Window.partitionBy()  # one row a date
    places = days.select((F.row_number().over(dates()) - 1).alias("i"), F.count("*").over(whole).alias("n"))
    places = places.withColumn("fold", F.floor(F.col("i") / F.ceil(F.col("n") / folds)).cast("long"))
    ends = places.groupBy("fold").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.max("n").alias("n"))
    lost = F.least(F.col("b") + purge + embargo, F.col("n") - 1) - F.greatest(F.col("a") - purge, F.lit(0)) + 1
    return ends.select("fold", (F.col("b") - F.col("a") + 1).cast("long").alias("test_days"), (F.col("n") - lost).cast("long").alias("train_days"))
