"""Strategies from factors to weights: votes, overlays on a portfolio, state machines, combination and comparison.

Panels are long and dense: one row for each symbol and date, weights 0 where nothing is held.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import average_rank, by_date, change, correlation, dates, dates_prefix, first_rank, lag, ratio, rolling, smoothed
from barloom.operators.cross_section import quantile_groups
from barloom.operators.portfolio import YEAR, breadth, told, volatility_target, walked


def scaled(df: DataFrame, scale: DataFrame, weight: str = "weight") -> DataFrame:
    """Weights times the scale of their date (one row a date); dates without one keep their weights."""
    return df.join(scale.select("eob", F.col("scale").alias("scale_")), "eob", "left").withColumn(weight, F.col(weight) * F.coalesce("scale_", F.lit(1.0))).drop("scale_")


def index_trend(index: DataFrame, period: int = 120) -> DataFrame:
    """1 on dates on which an index (eob, close) stands above its mean, else 0."""
    frame = dates().rowsBetween(-(period - 1), 0)
    mean = F.when(F.count("close").over(frame) >= max(1, period // 2), F.avg("close").over(frame))
    return index.select("eob", F.coalesce((F.col("close") > mean).cast("double"), F.lit(0.0)).alias("trend"))


def trend_scale(index: DataFrame, period: int = 120, down: float = 0.5) -> DataFrame:
    return index_trend(index, period).select("eob", F.when(F.col("trend") == 1, 1.0).otherwise(down).alias("scale"))


def breadth_scale(df: DataFrame, threshold: float = 0.3, below: float = 0.5, period: int = 20) -> DataFrame:
    return breadth(df, period).select("eob", F.when(F.col("breadth") < threshold, below).otherwise(1.0).alias("scale"))


def portfolio_filters(df: DataFrame, index: DataFrame, breadth_args: dict, trend_args: dict, target_args: dict) -> DataFrame:
    """Breadth, index trend and volatility target one after another; each sees the weights that the one before left."""
    df = scaled(df, breadth_scale(df, **breadth_args))
    df = scaled(df, trend_scale(index, **trend_args))
    return scaled(df, volatility_target(df, **target_args))


def exposure_control(df: DataFrame, window: int = 20, quantile: float = 0.75, span: int = 252, least: int = 20, gross: float = 0.75) -> DataFrame:
    """For each date whether the universe's mean volatility exceeds its trailing quantile, and the scale that then holds the gross weight at `gross`."""
    rows = df.withColumn("r_", change())
    rows = rows.withColumn("v_", rolling(F.stddev_samp, "r_", window) * math.sqrt(YEAR))
    daily = rows.groupBy("eob").agg(F.avg("v_").alias("volatility"), F.sum(F.abs("weight")).alias("before"))
    past = dates().rowsBetween(-span, -1)
    limit = F.when(F.count("volatility").over(past) >= min(least, span), F.percentile("volatility", F.lit(quantile)).over(past))
    daily = daily.withColumn("threshold", limit).withColumn("active", F.coalesce(F.col("volatility") > F.col("threshold"), F.lit(False)))
    scale = F.when(F.col("active") & (F.col("before") > 0), F.least(F.lit(gross) / F.col("before"), F.lit(1.0))).otherwise(1.0)
    return daily.withColumn("scale", scale).withColumn("after", F.col("before") * F.col("scale"))


# ---- exits


def loss_size(df: DataFrame) -> DataFrame:
    """The size of a falling bar's loss, 0 for others and null on the first."""
    return df.withColumn("exit", -F.when(change().isNotNull(), F.least(change(), F.lit(0.0))))


def drawdown_scale(df: DataFrame, threshold: float = 0.08, scale: float = 0.5, lookback: int = 20) -> DataFrame:
    """`scale` where the close lies `threshold` or more under the highest of the window, else 1."""
    high = rolling(F.max, "close", lookback, 1)
    fall = F.coalesce(ratio(high - F.col("close"), high), F.lit(0.0))
    return df.withColumn("exit", F.when(fall >= threshold, scale).otherwise(1.0))


# ---- the top-share strategy


def vote_weights(df: DataFrame, votes: str = "votes") -> DataFrame:
    """Each date's weights in proportion to votes; 0 where there is none."""
    return df.withColumn("weight", F.coalesce(F.try_divide(F.col(votes), F.sum(votes).over(by_date())), F.lit(0.0)))


def filtered(df: DataFrame, keep: Column, policy: str = "keep_cash", defensive: list[str] | None = None, risk: str | None = None) -> DataFrame:
    """Weights of rows that fail `keep` go to 0; what they free stays cash, is shared out, or goes to defensive symbols.

    Without a list the defensive symbol of a date is the held one with the smallest `risk` (ties by symbol; null risks last).
    """
    df = df.withColumn("weight", F.when(F.coalesce(keep, F.lit(False)), F.col("weight")).otherwise(0.0))
    total = F.sum("weight").over(by_date())
    if policy == "keep_cash":
        return df
    if policy == "renormalize":
        return df.withColumn("weight", F.coalesce(F.try_divide(F.col("weight"), total), F.lit(0.0)))
    if policy != "allocate_defensive":
        raise ValueError("policy is keep_cash, renormalize or allocate_defensive")
    spare = F.greatest(1 - total, F.lit(0.0))
    if defensive:
        own = F.col("symbol").isin(defensive)
        return df.withColumn("weight", F.col("weight") + F.when(own, spare / F.sum(own.cast("long")).over(by_date())).otherwise(0.0))
    place = F.row_number().over(by_date().orderBy((F.col("weight") > 0).desc(), F.col(risk).asc_nulls_last(), "symbol"))
    chosen = (place == 1) & (F.col("weight") > 0)
    return df.withColumns({"chosen_": chosen, "spare_": spare}).withColumn("weight", F.col("weight") + F.when(F.col("chosen_"), F.col("spare_")).otherwise(0.0)).drop("chosen_", "spare_")


# ---- long and short, predictions


def long_short(df: DataFrame, factor: str, groups: int, rebalance: DataFrame, short: bool = True) -> DataFrame:
    """On rebalance dates equal weights of the highest group, and minus those of the lowest; other dates have no rows.

    A date needs as many values as groups and two different ones.
    """
    rows = df.where(F.col(factor).isNotNull()).join(rebalance.select("eob"), "eob", "left_semi")
    rows = rows.withColumns({"n_": F.count("*").over(by_date()), "low_": F.min(factor).over(by_date()), "high_": F.max(factor).over(by_date())})
    rows = quantile_groups(rows.where((F.col("n_") >= groups) & (F.col("low_") < F.col("high_"))), factor, groups)
    size = F.count("*").over(Window.partitionBy("eob", "bucket"))
    side = F.when(F.col("bucket") == groups, 1 / size).when((F.col("bucket") == 1) & F.lit(short), -1 / size).otherwise(0.0)
    return rows.withColumn("weight", side).drop("n_", "low_", "high_")


def spread_weight(high: Column, low: Column, threshold: float) -> Column:
    """1, -1 or 0 as the difference of two probabilities lies above, below or within the threshold."""
    return F.when(high - low > threshold, 1.0).when(high - low < -threshold, -1.0).otherwise(0.0)


def predicted_positions(df: DataFrame, reverse: list[tuple[float, float]] = (), drop: list[tuple[float, float]] = (), delay: int = 1) -> DataFrame:
    """Positions from labels: turned round or dropped (the last one stays) by ranges of the score, `delay` rows late."""
    within = lambda ranges: reduce(Column.__or__, [(F.col("score") >= a) & (F.col("score") < b) for a, b in ranges], F.lit(False))
    own = F.coalesce(F.col("label").cast("double"), F.lit(0.0))
    df = df.withColumn("p_", F.when(within(drop), F.lit(None)).otherwise(F.when(within(reverse), -own).otherwise(own)))
    past = Window.partitionBy("symbol").orderBy("eob").rowsBetween(Window.unboundedPreceding, -delay)
    return df.withColumn("position", F.coalesce(F.last("p_", ignorenulls=True).over(past), F.lit(0.0))).drop("p_")


# ---- state machines


def golden_cross(df: DataFrame, short: int = 10, long: int = 60) -> DataFrame:
    """1 while the short mean stands above the long one."""
    return df.withColumn("weight", F.coalesce((rolling(F.avg, "close", short) > rolling(F.avg, "close", long)).cast("double"), F.lit(0.0)))


def _range(df: DataFrame, lookback: int) -> DataFrame:
    """Smoothed absolute changes of the close, null until `lookback` of them are there."""
    rows = df.withColumn("d_", F.abs(F.col("close") - lag("close")))
    rows = smoothed(rows.withColumn("n_", F.count("d_").over(Window.partitionBy("symbol").orderBy("eob").rowsBetween(Window.unboundedPreceding, 0))), {"range_": ("d_", 1 / lookback)})
    return rows.withColumn("range_", F.when(F.col("n_") >= lookback, F.col("range_"))).drop("d_", "n_")


def target_exposure(target: float, lookback: int) -> tuple[dict[str, Column], Column]:
    """A step with log returns, and the share that brings their deviation a year to the target, 1 at most."""
    volatility = rolling(F.stddev_samp, "lr_", lookback) * math.sqrt(YEAR)
    return {"lr_": F.log(ratio("close", lag("close")))}, F.when(volatility == 0, 1.0).otherwise(F.least(F.try_divide(F.lit(target), volatility), F.lit(1.0)))


def _prior(fn: Callable[[str], Column], n: int) -> Column:
    """An aggregate of the n closes before the present one."""
    past = Window.partitionBy("symbol").orderBy("eob").rowsBetween(-n, -1)
    return F.when(F.count("close").over(past) >= n, fn("close").over(past))


def channel_machine(multiplier: float) -> Callable[[], Callable[..., float]]:
    """Positions between a channel and a stop that only rises, from close, channel, range and share at each row."""

    def machine() -> Callable[..., float]:
        held, mark, stop, last = False, 0.0, 0.0, 0.0

        def walk(price: float | None, upper: float | None, lower: float | None, width: float | None, share: float | None) -> float:
            nonlocal held, mark, stop, last
            if price is None or not price > 0:
                return last
            if None in (upper, lower, width, share):
                last = 0.0
                return last
            if held:
                mark = max(mark, price)
                stop = max(stop, mark - multiplier * width)
                held = price > stop and price > lower
            elif price > upper:
                held, mark, stop = True, price, price - multiplier * width
            last = share if held else 0.0
            return last

        return walk

    return machine


def donchian_weights(df: DataFrame, entry: int = 20, leave: int = 10, span: int = 14, multiplier: float = 2.0, target: float = 0.15, lookback: int = 20, sizing: str = "target_vol") -> DataFrame:
    """In above the highest close of `entry` bars; out below the lowest of `leave` bars or a stop that only rises.

    A position is 1 (`fixed`) or what brings it to the `target` volatility. A row whose close is null or not positive keeps
    the position and the stop as they were.
    """
    if sizing not in ("fixed", "target_vol"):
        raise ValueError(f"unknown sizing: {sizing}")
    step, exposure = target_exposure(target, lookback)
    rows = _range(df, span).withColumns(step).withColumns({"upper_": _prior(F.max, entry), "lower_": _prior(F.min, leave), "share_": exposure if sizing == "target_vol" else F.lit(1.0)})

    return walked(rows, channel_machine(multiplier), ("close", "upper_", "lower_", "range_", "share_"))


def trend_weights(df: DataFrame, fast: int = 10, slow: int = 20, trend: int = 40, slope: int = 5, breakout: int = 20, leave: int = 10, span: int = 14,
                  first_stop: float = 2.0, trail: float = 3.0, target: float = 0.15, lookback: int = 20) -> DataFrame:
    """In on a breakout in a rising trend whose fast mean leads; out at a trailing stop, a low or below the trend."""
    step, exposure = target_exposure(target, lookback)
    means = {"fast_": rolling(F.avg, "close", fast), "slow_": rolling(F.avg, "close", slow), "trend_": rolling(F.avg, "close", trend)}
    rows = _range(df, span).withColumns(step).withColumns(means | {"upper_": _prior(F.max, breakout), "lower_": _prior(F.min, leave), "share_": exposure})
    rows = rows.withColumn("rising_", F.coalesce((F.col("trend_") > lag("trend_", slope)).cast("double"), F.lit(0.0)))

    def machine() -> Callable[..., float]:
        held, mark, stop = False, 0.0, 0.0

        def walk(price, fast_, slow_, trend_, rising, upper, lower, width, share) -> float:
            nonlocal held, mark, stop
            if None in (fast_, slow_, trend_, upper, lower, width, share):
                return 0.0
            if held:
                mark = max(mark, price)
                stop = max(stop, mark - trail * width)
                held = price > stop and price > lower and price >= trend_
            elif price > trend_ and rising and price > upper and fast_ > slow_:
                held, mark, stop = True, price, price - first_stop * width
            return share if held else 0.0

        return walk

    return walked(rows, machine, ("close", "fast_", "slow_", "trend_", "rising_", "upper_", "lower_", "range_", "share_"))


def volatility_bands(lookback: int, regime: int, low: float, high: float, exposures: tuple[float, float, float]) -> tuple[list[dict[str, Column]], Column]:
    """Steps and the share that a bar's volatility takes from where it lies among the `regime` volatilities before it."""
    steps = [{"lr_": F.log(ratio("close", lag("close")))}, {"v_": rolling(F.stddev_samp, "lr_", lookback) * math.sqrt(YEAR)}, {"v0_": lag("v_")}]
    below, above = (rolling(lambda x, q=q: F.percentile(x, q), "v0_", regime) for q in (low, high))
    return steps, F.when(F.col("v_") <= below, exposures[0]).when((F.col("v_") > below) & (F.col("v_") <= above), exposures[1]).when(F.col("v_") > above, exposures[2])


def vol_recovery_weights(df: DataFrame, family: str = "target_vol", trend: int = 120, breakout: int = 40, fast: int = 20, slow: int = 60, slope: int = 20, lookback: int = 20,
                         target: float = 0.10, regime: int = 252, quantiles: tuple[float, float] = (1 / 3, 2 / 3), exposures: tuple[float, float, float] = (1.0, 0.6, 0.3),
                         loss_stop: float = 0.08, recovery: float = 0.03, cooldown: int = 5, reduce_at: float = 0.04, reduced: float = 0.5) -> DataFrame:
    """In on a breakout in a rising trend, sized by volatility; out at a loss or when the trend ends; in again after a loss once the price recovered.

    `family` sizes by a target (target_vol), by bands of past volatility (vol_band), or by a target that an
    open loss of `reduce_at` cuts until half of it is won back (hybrid). Flat while an input is missing.
    """
    if family not in ("target_vol", "vol_band", "hybrid"):
        raise ValueError(f"unknown family {family}")
    means = {"fast_": rolling(F.avg, "close", fast), "slow_": rolling(F.avg, "close", slow), "trend_": rolling(F.avg, "close", trend), "upper_": _prior(F.max, breakout)}
    if family == "vol_band":
        steps, exposure = volatility_bands(lookback, regime, *quantiles, exposures)
    else:
        step, exposure = target_exposure(target, lookback)
        steps = [step]
    for step in steps:
        df = df.withColumns(step)
    rows = df.withColumns(means | {"share_": exposure})
    up = (F.col("close") > F.col("trend_")) & (F.col("trend_") > lag("trend_", slope)) & (F.col("fast_") > F.col("slow_"))
    rows = rows.withColumn("up_", F.coalesce(up, F.lit(False)))

    def machine() -> Callable[..., float]:
        at, held, entry, cut, stopped = -1, False, 0.0, False, None

        def walk(price, fast_, slow_, trend_, upper, share, rising) -> float:
            nonlocal at, held, entry, cut, stopped
            at += 1
            if None in (fast_, slow_, trend_, upper, share):
                return 0.0
            if held:
                gain = price / entry - 1
                if gain <= -loss_stop:
                    held, stopped = False, (at, price)
                elif not rising:
                    held = False
                elif family == "hybrid":
                    cut = gain < -reduce_at / 2 if cut else gain <= -reduce_at
            else:
                enters = price > upper if stopped is None else at - stopped[0] >= cooldown and price >= stopped[1] * (1 + recovery)
                if rising and enters:
                    held, entry, cut, stopped = True, price, False, None
            return share * (reduced if cut else 1.0) if held else 0.0

        return walk

    return walked(rows, machine, ("close", "fast_", "slow_", "trend_", "upper_", "share_", "up_"))


def satellite_machine(core: float, oversold: float, defensive: float, profit: float, stop: float, longest: int, recovery: float, cooldown: int, drop: float, longest_defence: int, told: bool = False) -> Callable[[], Callable[..., float | tuple]]:
    """Exposures of the core, the satellite and the defence, from close, mean, pullback and the two crossings at each row; if `told`, with the state's name and what happened."""

    def machine() -> Callable[..., float | tuple]:
        at, guard, satellite, stopped = -1, None, None, None  # each: the bar and the price it began with

        def left(price: float, mean_: float | None) -> str | None:
            """Why the satellite closes, if it does."""
            gain = price / satellite[1] - 1
            if gain >= profit:
                return "take_profit"
            if gain <= -stop:
                return "stop"
            if at - satellite[0] >= longest:
                return "time"
            return "mean" if mean_ is not None and price >= mean_ else None

        def walk(price, mean_, pull, oversold_, far) -> float | tuple:
            nonlocal at, guard, satellite, stopped
            at, events = at + 1, []
            if price is not None and price > 0:
                if guard:
                    fell = price <= guard[1] * (1 - drop)
                    if fell or at - guard[0] >= longest_defence:
                        guard = None
                        events.append("defensive_exit_pullback" if fell else "defensive_exit_time")
                why = left(price, mean_) if satellite else None
                if why:
                    satellite, stopped = None, (at, price) if why == "stop" else stopped
                    events.append(f"oversold_exit_{why}")
                if not guard and far:
                    guard, satellite = (at, price), None
                    events.append("defensive_entry")
                elif not guard and not satellite:
                    if stopped:
                        if not pull:
                            stopped = None
                        elif at - stopped[0] >= cooldown and price >= stopped[1] * (1 + recovery):
                            satellite, stopped = (at, price), None
                            events.append("oversold_reentry_recovery")
                    elif oversold_:
                        satellite = (at, price)
                        events.append("oversold_entry")
            weight = defensive if guard else oversold if satellite else core
            if not told:
                return weight
            return weight, "defensive" if guard else "oversold_satellite" if satellite else "recovery_wait" if stopped else "core", "|".join(events)

        return walk

    return machine


def _crossings(df: DataFrame, rsi: int, rsi_below: float, mean: int, trend: int, slope: int, low: int, distance: float) -> DataFrame:
    """The rows with the mean, whether the price pulls back under a rising trend, and the first rows that are oversold there or far from the low."""
    step = {"d_": F.col("close") - lag("close")}
    gains = {"g_": rolling(F.avg, F.greatest("d_", F.when(F.col("d_").isNotNull(), 0.0)), rsi), "l_": rolling(F.avg, F.greatest(-F.col("d_"), F.when(F.col("d_").isNotNull(), 0.0)), rsi)}
    levels = {"mean_": rolling(F.avg, "close", mean), "trend_": rolling(F.avg, "close", trend), "low_": rolling(F.min, "close", low)}
    strength = F.coalesce(100 - 100 / (1 + F.try_divide("g_", "l_")), F.lit(50.0))
    rows = df.withColumns(step).withColumns(gains | levels)
    rows = rows.withColumn("pull_", F.coalesce((F.col("close") < F.col("trend_")) & (F.col("trend_") > lag("trend_", slope)), F.lit(False)))
    rows = rows.withColumns({"o_": (strength <= rsi_below) & F.col("pull_"), "f_": F.coalesce(F.try_divide("close", "low_") - 1 >= distance, F.lit(False))})
    crossed = lambda x: F.col(x) & ~F.coalesce(lag(x), F.lit(False))
    rows = rows.withColumns({"oc_": crossed("o_"), "fc_": crossed("f_")})
    return rows


def core_satellite_weights(df: DataFrame, core: float = 1.0, oversold: float = 1.5, defensive: float = 0.0, rsi: int = 14, rsi_below: float = 35.0, mean: int = 20, trend: int = 120,
                           slope: int = 20, profit: float = 0.07, stop: float = 0.07, longest: int = 10, recovery: float = 0.03, cooldown: int = 5,
                           low: int = 60, distance: float = 0.13, drop: float = 0.05, longest_defence: int = 10) -> DataFrame:
    """A core that stays, a satellite at an oversold first crossing under a rising trend, and a defence when the price runs far from its low.

    The defence goes before the satellite. A satellite closed by its stop opens again once a cooldown is over
    and the price recovered while the pullback lasts. Crossings are windows; the machine sees only flags. A row whose
    close is null or not positive keeps the state it meets.
    """
    rows = _crossings(df, rsi, rsi_below, mean, trend, slope, low, distance)
    machine = satellite_machine(core, oversold, defensive, profit, stop, longest, recovery, cooldown, drop, longest_defence)
    return walked(rows, machine, ("close", "mean_", "pull_", "oc_", "fc_"))


def core_satellite_states(df: DataFrame, core: float = 1.0, oversold: float = 1.5, defensive: float = 0.0, rsi: int = 14, rsi_below: float = 35.0, mean: int = 20, trend: int = 120, slope: int = 20, profit: float = 0.07, stop: float = 0.07,
                          longest: int = 10, recovery: float = 0.03, cooldown: int = 5, low: int = 60, distance: float = 0.13, drop: float = 0.05, longest_defence: int = 10) -> DataFrame:
    """The same rule told row by row: symbol, eob, weight, state (core, oversold_satellite, recovery_wait, defensive) and the events of the row, joined by |."""
    machine = satellite_machine(core, oversold, defensive, profit, stop, longest, recovery, cooldown, drop, longest_defence, told=True)
    rows = _crossings(df, rsi, rsi_below, mean, trend, slope, low, distance)
    return told(rows, machine, ("close", "mean_", "pull_", "oc_", "fc_"), ("state", "event"))


# ---- several strategies: rows of strategy, eob, ret


def strategy_weights(returns: DataFrame, method: str = "equal", lookback: int = 60, custom: dict[str, float] | None = None) -> DataFrame:
    """strategy and its share: equal, given, or by the inverse deviation of its last `lookback` dates."""
    if method == "custom":
        total = sum(custom.values())
        return returns.sparkSession.createDataFrame([(k, v / total) for k, v in custom.items()], "strategy string, share double")
    last = F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("eob"))) <= lookback
    risk = returns.withColumn("last_", last).groupBy("strategy").agg(F.stddev_samp(F.when(F.col("last_"), F.col("ret"))).alias("s_"))
    whole = Window.partitionBy()  # one row a strategy
    even = 1 / F.count("*").over(whole)
    inverse = F.coalesce(F.try_divide(F.lit(1.0), F.col("s_")), F.lit(0.0))
    share = even if method == "equal" else F.coalesce(F.try_divide(inverse, F.sum(inverse).over(whole)), even)
    return risk.select("strategy", share.alias("share"))


def combined(returns: DataFrame, shares: DataFrame) -> DataFrame:
    """Daily returns of the mix, their running sum and its fall below its high."""
    daily = returns.join(shares, "strategy").groupBy("eob").agg(F.sum(F.col("ret") * F.col("share")).alias("combined"))
    daily = daily.withColumn("cumulative", F.sum("combined").over(dates_prefix()))
    return daily.withColumn("drawdown", F.col("cumulative") - F.max("cumulative").over(dates_prefix()))


def compared(returns: DataFrame) -> DataFrame:
    """Performance of each strategy, in one pass over all."""
    before = Window.partitionBy("strategy").orderBy("eob").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("e_", F.product(1 + F.col("ret")).over(before)).withColumn("dd_", 1 - F.col("e_") / F.max("e_").over(before))
    out = rows.groupBy("strategy").agg(
        (F.max_by("e_", "eob") - 1).alias("total_return"), F.max("dd_").alias("max_drawdown"), (F.stddev_samp("ret") * math.sqrt(YEAR)).alias("v_"), F.count("*").alias("days")
    )
    out = out.withColumn("ann_return", F.pow(1 + F.col("total_return"), F.lit(float(YEAR)) / F.col("days")) - 1)
    return out.select("strategy", "total_return", "ann_return", "max_drawdown", F.try_divide("ann_return", "v_").alias("sharpe"), F.try_divide("ann_return", "max_drawdown").alias("calmar"))


def benchmark_correlation(daily: DataFrame, index: DataFrame) -> DataFrame:
    """Correlation of a dated return `ret` with the changes of an index (eob, close)."""
    moves = index.select("eob", (ratio(F.col("close"), F.lag("close").over(dates())) - 1).alias("b_"))
    return daily.join(moves, "eob").agg(correlation("ret", "b_").alias("correlation"))


# ---- factors over time


def rolling_factor_correlation(df: DataFrame, factors: list[str], window: int, least: int) -> DataFrame:
    """Rolling mean of the daily rank correlation of each pair of factors."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    ranks = df.withColumns({f"k_{f}": average_rank(f) for f in factors})
    daily = ranks.groupBy("eob").agg(*[correlation(f"k_{a}", f"k_{b}").alias(f"c_{a}_{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(f"c_{a}_{b}").alias("c")) for a, b in pairs])
    long = daily.select("eob", F.explode(cells).alias("x")).select("eob", "x.*")
    frame = Window.partitionBy("factor_a", "factor_b").orderBy("eob").rowsBetween(-(window - 1), 0)
    return long.select("factor_a", "factor_b", "eob", F.when(F.count("c").over(frame) >= least, F.avg("c").over(frame)).alias("correlation"))


def capped(weights: Column, cap: float, n: int) -> Column:
    """n non-negative weights of sum 1 held under a cap, the excess shared among those below it in proportion (equal if all are 0)."""
    if cap * n < 1 - 1e-12:
        raise ValueError("the cap is too low for the number of factors")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    clean = F.transform(weights, lambda v: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)))
    own = F.transform(clean, lambda v: F.coalesce(F.try_divide(v, total(clean)), F.lit(1.0 / n)))

    def round_(w: Column) -> Column:
        """What is above the cap falls to it, and the rest takes what is left in proportion."""
        free = F.filter(w, lambda v: v < cap - 1e-12)
        left, base = 1 - (F.size(w) - F.size(free)) * cap, total(free)
        return F.transform(w, lambda v: F.when(v >= cap - 1e-12, F.lit(cap)).otherwise(F.when(base > 0, left * v / base).otherwise(left / F.greatest(F.size(free), F.lit(1)))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), own, lambda w, _: round_(w))  # each round fixes one more at the cap, or nothing changes


def factor_weights(daily_ic: DataFrame, factors: list[str], lookback: int, least: int, delay: int, cap: float, scaled_by_risk: bool = False) -> DataFrame:
    """Weights of factors on each date from the mean (or mean over deviation) of their ICs known `delay` dates before, capped.

    daily_ic: one row a date, one column of ICs a factor.
    """
    frame = dates().rowsBetween(-(lookback - 1 + delay), -delay)
    raw = []
    for f in factors:
        mean = F.when(F.count(f).over(frame) >= least, F.avg(f).over(frame))
        raw.append(F.try_divide(mean, F.stddev_samp(f).over(frame)) if scaled_by_risk else mean)
    rows = daily_ic.select("eob", F.array(*raw).alias("w_")).select("eob", capped(F.col("w_"), cap, len(factors)).alias("w_"))
    return rows.select("eob", *[F.get("w_", F.lit(i)).alias(f) for i, f in enumerate(factors)])


def icir_weights(daily_ic: DataFrame, correlations: DataFrame, factors: list[str], lookback: int = 252, least: int = 126, delay: int = 1, cap: float = 0.5, shrinkage: float = 0.5) -> DataFrame:
    """Weights of factors on each date that maximise the combined IC ratio: the IC ratios over the factors' correlations, negative ones at 0, capped.

    daily_ic: one row a date, one column of ICs a factor; correlations: factor_a, factor_b, eob, correlation, one row a
    date and pair in either order. Both are known `delay` dates later. The correlations are drawn to none by `shrinkage`. A date
    on which one is missing has equal weights. Each date is one small solve, by itself.
    """
    n = len(factors)
    if cap * n < 1 - 1e-12:
        raise ValueError("the cap is too low for the number of factors")
    place = {f: i for i, f in enumerate(factors)}
    frame = dates().rowsBetween(-(lookback - 1 + delay), -delay)
    ratios = [F.when(F.count(f).over(frame) >= least, F.try_divide(F.avg(f).over(frame), F.stddev_samp(f).over(frame))).alias(f"m_{i}") for i, f in enumerate(factors)]
    known = correlations.where(F.col("factor_a").isin(factors) & F.col("factor_b").isin(factors) & (F.col("factor_a") != F.col("factor_b")))
    number = lambda c: F.element_at(F.create_map(*[F.lit(x) for f, i in place.items() for x in (f, i)]), F.col(c))
    low, high = F.least(number("factor_a"), number("factor_b")), F.greatest(number("factor_a"), number("factor_b"))
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    wide = known.groupBy("eob").agg(*[F.max(F.when((low == i) & (high == j), F.col("correlation"))).alias(f"c_{i}_{j}") for i, j in pairs])
    rows = daily_ic.select("eob", *ratios).join(wide, "eob", "left")
    rows = rows.select("eob", *[f"m_{i}" for i in range(n)], *[F.lag(f"c_{i}_{j}", delay).over(dates()).alias(f"c_{i}_{j}") for i, j in pairs])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda name, batch=batch: batch.column(name).to_numpy(zero_copy_only=False).astype(float)
            mean = np.stack([read(f"m_{i}") for i in range(n)], 1)
            matrix = np.zeros((batch.num_rows, n, n)) + np.eye(n)
            for i, j in pairs:
                matrix[:, i, j] = matrix[:, j, i] = read(f"c_{i}_{j}")
            whole = np.isfinite(matrix).all(axis=(1, 2)) & np.isfinite(mean).all(axis=1)
            out = np.zeros((batch.num_rows, n))
            if whole.any():
                drawn = (1 - shrinkage) * matrix[whole] + (shrinkage + 1e-8) * np.eye(n)
                out[whole] = np.linalg.solve(drawn, mean[whole][:, :, None])[:, :, 0]
            yield pa.RecordBatch.from_arrays([batch.column("eob"), pa.array(np.maximum(out, 0.0).tolist(), pa.list_(pa.float64()))], ["eob", "w_"])

    weights = rows.mapInArrow(solved, f"eob {dict(daily_ic.dtypes)['eob']}, w_ array<double>").select("eob", capped(F.col("w_"), cap, n).alias("w_"))
    return weights.select("eob", *[F.get("w_", F.lit(i)).alias(f) for i, f in enumerate(factors)])


def log_differences(df: DataFrame, factors: tuple[str, ...] = ("open", "high", "low", "close"), lags: tuple[int, ...] = (1,), shifts: tuple[int, ...] = (0, 5)) -> DataFrame:
    """Log of each price less the lagged log of each, shifted; rows with a missing one go."""
    df = df.withColumns({f"l_{f}": F.log(F.when(F.col(f) > 0, F.col(f))) for f in factors})
    made = {f"logdiff_{a}_{b}{k}_shift{s}": lag(F.col(f"l_{a}"), s) - lag(F.col(f"l_{b}"), k + s) if s else F.col(f"l_{a}") - lag(F.col(f"l_{b}"), k) for a in factors for b in factors for k in lags for s in shifts}
    return df.withColumns(made).drop(*[f"l_{f}" for f in factors]).dropna(subset=list(made))


def round_away(x: Column, digits: int = 3) -> Column:
    """Rounded away from 0; 0 stays."""
    return F.when(x > 0, F.ceil(x * 10**digits) / 10**digits).when(x < 0, F.floor(x * 10**digits) / 10**digits).when(x == 0, 0.0)


def top_weights_by(df: DataFrame, score: str, n: int) -> DataFrame:
    """Dense equal weights of each date's n best scores; 0 elsewhere."""
    place = F.when(F.col(score).isNotNull(), first_rank(score))
    picked = F.coalesce((place <= n).cast("double"), F.lit(0.0))
    return df.withColumn("p_", picked).withColumn("weight", F.coalesce(F.try_divide(F.col("p_"), F.sum("p_").over(by_date())), F.lit(0.0))).drop("p_")
