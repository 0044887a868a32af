"""Grids of parameters of the state machines: all settings in one pass, their figures side by side, and a ranking within the sample."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import lag, lead, ratio, rolling
from barloom.operators.portfolio import YEAR, walked_grid
from barloom.operators.strategies import _prior, _range, channel_machine, satellite_machine, target_exposure


def channel_grid(df: DataFrame, entries: tuple[int, ...] = (20, 40, 55), leaves: tuple[int, ...] = (10, 20, 30), spans: tuple[int, ...] = (14, 20), multipliers: tuple[float, ...] = (2.0, 3.0), target: float | None = None, lookback: int = 20) -> DataFrame:
    """Channel positions of every setting whose entry is longer than its exit: config, symbol, eob, weight.

    Each distinct channel and range is one window column, whatever the number of settings that use it. A
    position is 1, or what brings it to the `target` volatility.
    """
    rows = df
    for s in spans:
        rows = _range(rows, s).withColumnRenamed("range_", f"range_{s}")
    if target is None:
        rows = rows.withColumn("share_", F.lit(1.0))
    else:
        step, exposure = target_exposure(target, lookback)
        rows = rows.withColumns(step).withColumn("share_", exposure)
    rows = rows.withColumns({f"upper_{e}": _prior(F.max, e) for e in entries} | {f"lower_{x}": _prior(F.min, x) for x in leaves})
    kept = [v for v in itertools.product(entries, leaves, spans, multipliers) if v[0] > v[1]]
    if not kept:
        raise ValueError("no entry is longer than an exit")
    return walked_grid(rows, {f"channel_{e}_{x}_{s}_{m:g}": (channel_machine(m), ("close", f"upper_{e}", f"lower_{x}", f"range_{s}", "share_")) for e, x, s, m in kept})


def satellite_grid(
    df: DataFrame, distances: tuple[float, ...] = (0.12, 0.13, 0.14), defensives: tuple[float, ...] = (0.0, 0.25), longest_defences: tuple[int, ...] = (10, 15, 20), strengths: tuple[float, ...] = (30.0, 35.0, 40.0),
    oversolds: tuple[float, ...] = (1.25, 1.5), profits: tuple[float, ...] = (0.05, 0.07), stops: tuple[float, ...] = (0.05, 0.07, 0.1), longests: tuple[int, ...] = (10, 15, 20),
    core: float = 1.0, rsi: int = 14, mean: int = 20, trend: int = 120, slope: int = 20, recovery: float = 0.03, cooldown: int = 5, low: int = 60, drop: float = 0.05,
) -> DataFrame:
    """Exposures of the core, satellite and defence rule under every setting: config, symbol, eob, weight.

    Only the two crossings depend on thresholds of the grid (one column for each strength and distance); everything
    else of a setting is in its machine.
    """
    gain = lambda x: rolling(F.avg, F.greatest(x, F.when(F.col("d_").isNotNull(), 0.0)), rsi)
    rows = df.withColumns({"d_": F.col("close") - lag("close")})
    rows = rows.withColumns({"g_": gain(F.col("d_")), "l_": gain(-F.col("d_")), "mean_": rolling(F.avg, "close", mean), "trend_": rolling(F.avg, "close", trend), "low_": rolling(F.min, "close", low)})
    strength = F.coalesce(100 - 100 / (1 + F.try_divide("g_", "l_")), F.lit(50.0))
    rows = rows.withColumns({"pull_": F.coalesce((F.col("close") < F.col("trend_")) & (F.col("trend_") > lag("trend_", slope)), F.lit(False)), "strength_": strength})
    flags = {f"o{i}_": (F.col("strength_") <= s) & F.col("pull_") for i, s in enumerate(strengths)} | {f"f{i}_": F.coalesce(F.try_divide("close", "low_") - 1 >= d, F.lit(False)) for i, d in enumerate(distances)}
    rows = rows.withColumns(flags)
    rows = rows.withColumns({f"c{k}": F.col(k) & ~F.coalesce(lag(k), F.lit(False)) for k in flags})
    machines = {}
    grid = itertools.product(range(len(distances)), defensives, longest_defences, range(len(strengths)), oversolds, profits, stops, longests)
    for k, (d, defensive, defence, s, oversold, profit, stop, longest) in enumerate(grid, 1):
        machine = satellite_machine(core, oversold, defensive, profit, stop, longest, recovery, cooldown, drop, defence)
        machines[f"combined_{k:04d}"] = (machine, ("close", "mean_", "pull_", f"co{s}_", f"cf{d}_"))
    return walked_grid(rows, machines)


def grid_figures(df: DataFrame, weights: DataFrame, signal_lag: int = 1, cost_rate: float = 0.0004) -> DataFrame:
    """Figures of each setting over all symbols in equal parts, and its yearly excess over holding them: one row a setting.

    weights: config, symbol, eob, weight. The bars are joined once; each setting is a partition of its own from there on.
    Returns config, total_return, max_drawdown, sharpe, calmar, trade_days, median_fold_excess, worst_fold_excess.
    """
    moves = df.select("symbol", "eob", (ratio(lead("close"), F.col("close")) - 1).alias("f_"))
    own = Window.partitionBy("config", "symbol").orderBy("eob")
    rows = weights.withColumn("w_", F.coalesce(F.lag("weight", signal_lag).over(own) if signal_lag else F.col("weight"), F.lit(0.0)))
    rows = rows.withColumn("t_", F.abs(F.col("w_") - F.coalesce(F.lag("w_").over(own), F.lit(0.0)))).join(moves, ["symbol", "eob"]).where("f_ IS NOT NULL")
    daily = rows.groupBy("config", "eob").agg((F.avg(F.col("w_") * F.col("f_")) - F.avg("t_") * cost_rate).alias("ret"), F.avg("f_").alias("base"), F.avg("t_").alias("turnover"))
    run = Window.partitionBy("config").orderBy("eob").rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("e_", F.product(1 + F.col("ret")).over(run))
    daily = daily.withColumn("d_", 1 - F.col("e_") / F.max("e_").over(run))
    whole = daily.groupBy("config").agg(
        (F.max_by("e_", "eob") - 1).alias("total_return"), F.max("d_").alias("max_drawdown"), (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * math.sqrt(YEAR)).alias("sharpe"),
        F.count("*").alias("days"), F.sum((F.col("turnover") > 1e-8).cast("long")).alias("trade_days"),
    )
    years = daily.groupBy("config", F.year("eob").alias("year")).agg((F.product(1 + F.col("ret")) - F.product(1 + F.col("base"))).alias("excess"))
    folds = years.groupBy("config").agg(F.median("excess").alias("median_fold_excess"), F.min("excess").alias("worst_fold_excess"))
    annual = F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), F.lit(float(YEAR)) / F.col("days")) - 1)
    return whole.withColumn("calmar", F.try_divide(annual, "max_drawdown")).join(folds, "config").drop("days")


#: What the ranking within a sample is made of.
RANKED = {"calmar": 0.2, "sharpe": 0.15, "total_return": 0.1, "median_fold_excess": 0.3, "worst_fold_excess": 0.25}


def rank_in_sample(figures: DataFrame) -> DataFrame:
    """The settings with a score: weighted percent ranks of RANKED. One that never fell, traded on fewer than four dates or lost everything is not eligible and has no score; place counts from the best."""
    eligible = (F.col("max_drawdown") > 0) & (F.col("trade_days") >= 4) & (F.col("total_return") > -1)
    ranks = {}
    for c in RANKED:  # ties at their mean
        low, same = F.rank().over(Window.orderBy(F.col(c).asc_nulls_last())), F.count("*").over(Window.partitionBy(c))
        ranks[f"k_{c}"] = F.when(F.col(c).isNotNull(), (low + (same - 1) / 2) / F.count(c).over(Window.partitionBy()))
    rows = figures.withColumns(ranks)  # one row a setting
    score = sum((F.coalesce(F.col(f"k_{c}"), F.lit(0.0)) * w for c, w in RANKED.items()), F.lit(0.0))
    rows = rows.withColumns({"eligible": F.coalesce(eligible, F.lit(False)), "score": F.when(eligible, score)}).drop(*ranks)
    order = Window.orderBy(F.desc_nulls_last("score"), F.desc("worst_fold_excess"), F.desc("median_fold_excess"), "config")
    return rows.withColumn("place", F.row_number().over(order))
