"""Indicators and factors: each takes bars and returns them with one more column, `value`.

Bars have symbol, eob, open, high, low, close and volume. `INDICATORS` is the registry.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import (
    change, clip, filled, frame, lag, prefix, ratio, rolling, rolling2, rolling_correlation, row_no, safe_divide, scanned, smoothed, stages, zscore, zscore_or_null,
)

INDICATORS: dict[str, Callable[..., DataFrame]] = {}


def indicator(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    INDICATORS[fn.__name__] = fn
    return fn


WEIGHT_SMALL = 1e-10


def positive(x):
    return F.when(x > 0, x)


# ---- trend and momentum


@indicator
def roc(bars: DataFrame, period: int = 20) -> DataFrame:
    """Change over `period` bars; gaps take the last close."""
    return stages(bars, {"x": filled("close")}, {"value": change("x", period)})


@indicator
def ma(bars: DataFrame, period: int = 5) -> DataFrame:
    """Distance of the close from its mean, relative; 0 in the warm-up."""
    return stages(bars, {"m": rolling(F.avg, "close", period)}, {"value": safe_divide(F.col("close") - F.col("m"), F.col("m"))})


@indicator
def daily_return(bars: DataFrame) -> DataFrame:
    return stages(bars, {"x": filled("close")}, {"value": change("x")})


@indicator
def ma_cross(bars: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    return stages(bars, {"value": rolling(F.avg, "close", short) - rolling(F.avg, "close", long)})


@indicator
def price_above_ma(bars: DataFrame, period: int = 20) -> DataFrame:
    return stages(bars, {"value": F.col("close") - rolling(F.avg, "close", period)})


@indicator
def bias_momentum(bars: DataFrame, ma_period: int = 90, momentum_day: int = 25) -> DataFrame:
    """Slope of close over its long mean."""
    return stages(bars, {"t": row_no(), "b": ratio(F.col("close"), rolling(F.avg, "close", ma_period))}, {"value": rolling2(F.regr_slope, "b", "t", momentum_day)})


@indicator
def mom_skip(bars: DataFrame, skip: int = 22, total: int = 252) -> DataFrame:
    """Change between two lagged closes, without the latest bars."""
    return stages(bars, {"value": ratio(lag("close", skip), lag("close", total)) - 1})


@indicator
def trend_score(bars: DataFrame, period: int = 25) -> DataFrame:
    """Yearly slope of the log close times its R squared."""
    return stages(bars, {"t": row_no(), "y": F.log(positive(F.col("close")))}, {"value": rolling2(F.regr_slope, "y", "t", period) * 252 * rolling2(F.regr_r2, "y", "t", period)})


@indicator
def trend_score_v2(bars: DataFrame, period: int = 25) -> DataFrame:
    """Compounded slope of the log close times R squared."""
    steps = {"s": rolling2(F.regr_slope, "y", "t", period), "r": F.coalesce(rolling2(F.regr_r2, "y", "t", period), F.lit(0.0))}
    return stages(bars, {"t": row_no(), "y": F.log(positive(F.col("close")))}, steps, {"value": (F.exp(F.col("s") * 250) - 1) * F.col("r")})


@indicator
def trend_score_v2_skip(bars: DataFrame, period: int = 252, skip: int = 22) -> DataFrame:
    n = period - skip
    steps = {"s": rolling2(F.regr_slope, "y", "t", n), "r": F.coalesce(rolling2(F.regr_r2, "y", "t", n), F.lit(0.0))}
    return stages(bars, {"t": row_no(), "y": F.log(positive(lag("close", skip)))}, steps, {"value": (F.exp(F.col("s") * 250) - 1) * F.col("r")})


@indicator
def plain_trend_score(bars: DataFrame, lookback: int = 60) -> DataFrame:
    """Yearly slope of the log close."""
    return stages(bars, {"t": row_no(), "y": F.log(positive(F.col("close")))}, {"value": rolling2(F.regr_slope, "y", "t", lookback) * 252})


@indicator
def momentum_score(bars: DataFrame, lookback: int = 20) -> DataFrame:
    return stages(bars, {"value": change("close", lookback)})


@indicator
def mean_reversion_score(bars: DataFrame, lookback: int = 20) -> DataFrame:
    return stages(bars, {"value": -ratio(F.col("close") - rolling(F.avg, "close", lookback), rolling(F.stddev_samp, "close", lookback))})


@indicator
def ma_gap_reversal_score(bars: DataFrame, lookback: int = 20) -> DataFrame:
    return stages(bars, {"value": -(ratio(F.col("close"), rolling(F.avg, "close", lookback)) - 1)})


@indicator
def asset_class_momentum_score(bars: DataFrame, lookbacks: tuple[int, ...] = (20, 60, 120)) -> DataFrame:
    """Mean of the changes over several lookbacks."""
    return stages(bars, {"value": sum((change("close", n) for n in lookbacks), F.lit(0.0)) / len(lookbacks)})


@indicator
def er(bars: DataFrame, period: int = 14) -> DataFrame:
    """Efficiency ratio: net move over the path's length; 0 in the warm-up."""
    return stages(bars, {"d": F.abs(F.col("close") - lag("close"))}, {"value": safe_divide(F.abs(F.col("close") - lag("close", period)), rolling(F.sum, "d", period))})


# ---- channels and oscillators


@indicator
def cci(bars: DataFrame, period: int = 20) -> DataFrame:
    """Typical price's distance from its mean over 0.015 mean absolute deviations."""
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    steps = {"m": rolling(F.avg, "x", period), "a": F.collect_list("x").over(frame(period))}
    spread = F.aggregate("a", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("m"))) / period
    return stages(bars, {"x": price}, steps, {"value": ratio(F.col("x") - F.col("m"), spread * 0.015)})


@indicator
def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Strength of gains against losses by simple means; 50 where it is undefined."""
    d = F.col("close") - lag("close")
    steps = {"g": rolling(F.avg, F.greatest(F.col("d"), F.lit(0.0)), period, period), "s": rolling(F.avg, F.greatest(-F.col("d"), F.lit(0.0)), period, period)}
    return stages(bars, {"d": F.coalesce(d, F.lit(0.0))}, steps, {"value": F.coalesce(100 - 100 / (1 + ratio("g", "s")), F.lit(50.0))})


@indicator
def simple_rsi(bars: DataFrame, lookback: int = 14) -> DataFrame:
    d = F.col("d")
    up, down = F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))
    return stages(bars, {"d": F.col("close") - lag("close")}, {"u": up, "w": down}, {"value": F.coalesce(100 - 100 / (1 + ratio(rolling(F.avg, "u", lookback), rolling(F.avg, "w", lookback))), F.lit(50.0))})


@indicator
def williams_r(bars: DataFrame, period: int = 14, standardize_window: int = 60) -> DataFrame:
    """Williams %R around its centre, damped by up to half where the trend is strong, standardised."""
    top, bottom = rolling(F.max, "high", period), rolling(F.min, "low", period)
    raw = safe_divide(F.col("top") - F.col("close"), F.col("top") - F.col("bottom"), 0.5) * -100 + 50
    first = lag("close", period - 1)
    trend = F.when(F.count("close").over(frame(period)) >= period, F.when(first == 0, 0.0).otherwise(ratio(F.col("close") - first, first)))
    return stages(
        bars, {"top": top, "bottom": bottom, "trend": F.tanh(trend * 20)}, {"x": raw * (1 - F.abs("trend") * 0.5)},
        {"value": clip(zscore("x", standardize_window, period), -3, 3)},
    )


@indicator
def orb_relvol(bars: DataFrame, period: int = 14) -> DataFrame:
    """Volume over the mean volume up to the bar before; 1 where that is undefined."""
    return stages(bars, {"m": rolling(F.avg, "volume", period, 1)}, {"value": safe_divide(F.col("volume"), lag("m"), 1.0)})


@indicator
def donchian_channel(bars: DataFrame, period: int = 20, standardize_window: int = 60) -> DataFrame:
    """Place in the channel (0.4), breakout (0.3), distance from its middle (0.2) and width (0.1), standardised and smoothed."""
    top, bottom = rolling(F.max, "high", period), rolling(F.min, "low", period)
    beyond = F.greatest(F.col("close") - F.col("top"), F.lit(0.0)) + F.least(F.col("close") - F.col("bottom"), F.lit(0.0))
    beyond = F.when(F.col("top").isNotNull() & F.col("bottom").isNotNull(), beyond)
    place = (safe_divide(F.col("close") - F.col("bottom"), "width", 0.5) - 0.5) * 2
    trend = safe_divide(F.col("close") - (F.col("top") + F.col("bottom")) / 2, "width")
    blend = place * 0.4 + safe_divide(beyond, "width") * 0.3 + trend * 0.2 + F.tanh(2 - safe_divide("width", "usual", 1.0)) * 0.1
    rows = stages(
        bars, {"top": top, "bottom": bottom}, {"width": F.col("top") - F.col("bottom")}, {"usual": rolling(F.avg, "width", 2 * period, period)},
        {"x": blend}, {"z_": zscore("x", standardize_window, period)}, keep=("z_",),
    )
    return smoothed(rows, {"e_": ("z_", 0.1)}).withColumn("value", clip(F.col("e_"), -3, 3)).drop("z_", "e_")


@indicator
def slowkdj(bars: DataFrame, k_period: int = 14, k_smooth: int = 3, d_smooth: int = 3, standardize_window: int = 60) -> DataFrame:
    """Mean distance of slow K, D and J from overbought, scaled by momentum, standardised."""
    low, high = rolling(F.min, "low", k_period), rolling(F.max, "high", k_period)
    signal = ((100 - F.col("k")) + (100 - F.col("d")) + (100 - (F.col("k") * 3 - F.col("d") * 2))) / 3 - 50
    return stages(
        bars, {"r": safe_divide(F.col("close") - low, high - low, 0.5) * 100}, {"k": rolling(F.avg, "r", k_smooth)}, {"d": rolling(F.avg, "k", d_smooth)},
        {"x": signal * (1 + F.tanh(change("close", k_period) * 10) * 0.3)}, {"value": clip(zscore("x", standardize_window, k_period), -3, 3)},
    )


@indicator
def rsi_divergence(bars: DataFrame, rsi_period: int = 14, divergence_period: int = 20, standardize_window: int = 60) -> DataFrame:
    """Opposite slopes of price and strength (0.6) and strength beyond 30 and 70 (0.4), times the root of relative volatility, standardised."""
    d, k = F.col("close") - lag("close"), F.col("strength")
    gains, losses = F.greatest(F.col("d"), F.lit(0.0)), F.greatest(-F.col("d"), F.lit(0.0))
    slopes = {
        "a": rolling2(F.regr_slope, "close", "t", divergence_period), "b": rolling2(F.regr_slope, "strength", "t", divergence_period),
        "usual": rolling(F.avg, "s", standardize_window),
    }
    extreme = F.when(k > 70, -(k - 70) / 30).when(k < 30, (30 - k) / 30).otherwise(0.0)
    return stages(
        bars, {"d": F.coalesce(d, F.lit(0.0)), "r": change(), "t": row_no()},
        {"g": rolling(F.avg, gains, rsi_period), "l": rolling(F.avg, losses, rsi_period), "s": rolling(F.stddev_samp, "r", rsi_period)},
        {"strength": 100 - 100 / (1 + safe_divide("g", "l", 1.0))}, slopes,
        {"x": (-F.col("a") * F.col("b") * 0.6 + extreme * 0.4) * F.sqrt(safe_divide("s", "usual", 1.0))},
        {"value": clip(zscore("x", standardize_window, rsi_period), -3, 3)},
    )


@indicator
def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """Smoothed true range."""
    span = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("p")), F.abs(F.col("low") - F.col("p")))
    rows = stages(bars, {"p": lag("close")}, {"tr_": span}, keep=("tr_",))
    return smoothed(rows, {"value": ("tr_", 1 / period)}).drop("tr_")


@indicator
def supertrend(bars: DataFrame, period: int = 14, multiplier: float = 2.0, window: int = 60) -> DataFrame:
    """Where the close stands between bands that only tighten while the trend holds, with the trend's side, age and risk; standardised and smoothed.

    Bands, side and age are one pass over a symbol's rows; the rest are windows. Null until a band was touched.
    """
    middle = (F.col("high") + F.col("low")) / 2
    width = multiplier * (0.8 + 0.4 * F.tanh(safe_divide("a_", "m_", 1.0) - 1)) * F.col("a_")
    rows = atr(bars, period).withColumnRenamed("value", "a_").withColumn("m_", rolling(F.avg, "a_", 2 * period, period))
    rows = rows.withColumns({"u_": middle + width, "l_": middle - width})

    def machine() -> Callable[..., tuple]:
        at, last, top, bottom, side, age = 0, 0.0, 0.0, 0.0, None, 0

        def step(close: float, upper: float, lower: float) -> tuple:
            nonlocal at, last, top, bottom, side, age
            early, before = at < period, side
            if close is None or upper is None or lower is None:  # a row without a price leaves the bands and the trend as they are
                at += 1
                return top, bottom, side, float(age)
            if early or upper < top or last > top:
                top = upper
            if early or lower > bottom or last < bottom:
                bottom = lower
            if not early:
                side = -1.0 if close <= bottom else 1.0 if close >= top else side
            age = age + 1 if side is not None and side == before else 1
            at, last = at + 1, close
            return top, bottom, side, float(age)

        return step

    rows = scanned(rows, machine, ("close", "u_", "l_"), ("top_", "bottom_", "side_", "age_"))
    line = F.when(F.col("side_") == 1, F.col("bottom_")).when(F.col("side_") == -1, F.col("top_"))
    away = safe_divide(F.col("close") - line, line, 0.0)
    place = (safe_divide(F.col("close") - F.col("bottom_"), F.col("top_") - F.col("bottom_"), 0.5) - 0.5) * 2
    aged = clip(F.log1p("age_") / math.log1p(period), 0.1, 2.0)
    risk = F.tanh(safe_divide("v_", "vm_", 1.0))
    raw = away * 0.4 * F.col("side_") + place * 0.3 + aged * 0.2 * F.col("side_") + risk * 0.1 * F.col("side_")
    rows = stages(
        rows, {"r_": change()}, {"v_": rolling(F.stddev_samp, "r_", period)}, {"vm_": rolling(F.avg, "v_", 2 * period)}, {"x_": raw}, {"z_": zscore("x_", window, period)}, keep=("z_",)
    ).drop("a_", "m_", "u_", "l_", "top_", "bottom_", "side_", "age_")
    return smoothed(rows, {"e_": ("z_", 0.15)}).withColumn("value", clip(F.col("e_"), -3, 3)).drop("z_", "e_")


@indicator
def close_atr_proxy(bars: DataFrame, lookback: int = 14) -> DataFrame:
    """Smoothed absolute change of the close, null until `lookback` changes are there."""
    rows = stages(bars, {"d_": F.abs(F.col("close") - lag("close"))}, {"n_": F.count("d_").over(prefix())}, keep=("d_", "n_"))
    rows = smoothed(rows, {"e_": ("d_", 1 / lookback)})
    return rows.withColumn("value", F.when(F.col("n_") >= lookback, F.col("e_"))).drop("d_", "n_", "e_")


# ---- volatility


@indicator
def volatility_score(bars: DataFrame, lookback: int = 20) -> DataFrame:
    return stages(bars, {"r": change()}, {"value": -rolling(F.stddev_samp, "r", lookback)})


@indicator
def realized_volatility(bars: DataFrame, lookback: int = 20) -> DataFrame:
    return stages(bars, {"r": F.log(positive(ratio("close", lag("close"))))}, {"value": rolling(F.stddev_samp, "r", lookback) * math.sqrt(252)})


@indicator
def vr_downside_semivariance_premium(bars: DataFrame, period: int = 20) -> DataFrame:
    """Inverse of the losses' root mean square; a bar without a return counts as no loss."""
    s = F.col("s")
    return stages(bars, {"r": change()}, {"d": F.when(F.col("r") < 0, F.col("r")).otherwise(0.0)}, {"s": rolling(F.avg, F.col("d") * F.col("d"), period)}, {"value": F.tanh(ratio(F.lit(1.0), F.sqrt(F.when(s > 1e-12, s))))})


@indicator
def vr_vol_quantile_rank(bars: DataFrame, short_period: int = 10, long_lookback: int = 120) -> DataFrame:
    """Minus the share of the window's volatilities that are not above the present one."""
    share = F.size(F.filter("a", lambda x: x <= F.col("s"))) / F.size("a")
    return stages(bars, {"r": change()}, {"s": rolling(F.stddev_samp, "r", short_period)}, {"a": F.collect_list("s").over(frame(long_lookback))}, {"value": F.when(F.size("a") >= long_lookback, -share)})


@indicator
def vr_vol_mean_reversion_speed(bars: DataFrame, period: int = 20, lag_by: int = 5) -> DataFrame:
    return stages(bars, {"r": change()}, {"s": rolling(F.stddev_samp, "r", period)}, {"p": lag("s", lag_by)}, {"value": clip(-rolling_correlation("s", "p", period), -1, 1)})


@indicator
def vr_up_down_vol_asymmetry(bars: DataFrame, period: int = 20) -> DataFrame:
    """Log ratio of the root mean squares of gains and of losses, each over its own bars."""
    square = F.col("r") * F.col("r")
    steps = {}
    for name, cond in (("a", F.col("r") > 0), ("b", F.col("r") < 0)):
        total, n = rolling(F.sum, F.when(cond, square).otherwise(0.0), period), rolling(F.sum, F.when(cond, 1.0).otherwise(0.0), period)
        steps[name] = F.sqrt(ratio(total, n))
    a, b = F.col("a"), F.col("b")
    return stages(bars, {"r": change()}, steps, {"value": F.when((a > 1e-10) & (b > 1e-10), F.tanh(F.log(positive(a)) - F.log(positive(b))))})


@indicator
def vr_var_tail_risk_inverse(bars: DataFrame, period: int = 60, quantile: float = 0.05) -> DataFrame:
    return stages(bars, {"r": change()}, {"q": rolling(lambda x: F.percentile(x, F.lit(quantile)), "r", period)}, {"value": F.tanh(ratio(F.lit(1.0), F.abs("q")))})


@indicator
def vr_vol_clustering_autocorr(bars: DataFrame, period: int = 20, lag_by: int = 1) -> DataFrame:
    return stages(bars, {"r": F.abs(change())}, {"p": lag("r", lag_by)}, {"value": clip(-rolling_correlation("r", "p", period), -1, 1)})


@indicator
def vr_hurst_regime_persistence(bars: DataFrame, period: int = 100) -> DataFrame:
    """Rescaled range of the log close's window, as an exponent, minus one half, within one half of 0."""
    walk = F.aggregate(
        "a", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("top"), F.lit(0.0).alias("low"), F.lit(0).alias("n")),
        lambda z, x: F.struct(
            (z["s"] + x - F.col("m")).alias("s"),
            F.when(z["n"] == 0, z["s"] + x - F.col("m")).otherwise(F.greatest(z["top"], z["s"] + x - F.col("m"))).alias("top"),
            F.when(z["n"] == 0, z["s"] + x - F.col("m")).otherwise(F.least(z["low"], z["s"] + x - F.col("m"))).alias("low"),
            (z["n"] + 1).alias("n"),
        ),
        lambda z: z["top"] - z["low"],
    )
    steps = {"m": rolling(F.avg, "y", period), "s": rolling(F.stddev_samp, "y", period), "a": F.collect_list("y").over(frame(period))}
    spread = F.when(F.col("s") > 1e-12, F.col("s"))
    return stages(bars, {"y": F.log(positive(F.col("close")))}, steps, {"value": F.when(F.col("m").isNotNull(), clip(F.log(positive(ratio(walk, spread))) / math.log(period) - 0.5, -0.5, 0.5))})


@indicator
def vr2_sortino_downside_momentum(bars: DataFrame, period: int = 20, downside_target: float = 0.0) -> DataFrame:
    below = F.when(F.col("r").isNotNull(), F.least(F.col("r") - downside_target, F.lit(0.0)))
    steps = {"m": rolling(F.avg, "r", period), "s": F.sqrt(rolling(F.avg, F.col("d") * F.col("d"), period))}
    return stages(bars, {"r": change()}, {"d": below}, steps, {"value": F.tanh(ratio("m", F.when(F.col("s") > WEIGHT_SMALL, F.col("s"))))})


@indicator
def vr2_vol_term_structure_tanh(bars: DataFrame, short_period: int = 10, long_period: int = 60) -> DataFrame:
    steps = {"a": rolling(F.stddev_samp, "r", short_period), "b": rolling(F.stddev_samp, "r", long_period)}
    return stages(bars, {"r": change()}, steps, {"z": zscore("b", 2 * long_period, long_period)}, {"value": F.tanh(ratio("a", "b") - 1) * -0.6 - F.tanh("z") * 0.4})


@indicator
def vr2_calmar_risk_adjusted(bars: DataFrame, period: int = 60) -> DataFrame:
    """Change over the window over its largest drawdown; null where the window begins at no positive price or never falls."""
    worst = F.aggregate(
        "a", F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("dd")),
        lambda z, x: F.struct(F.greatest(z["top"], x).alias("top"), F.greatest(z["dd"], 1 - F.coalesce(ratio(x, F.greatest(z["top"], x)), F.lit(1.0))).alias("dd")), lambda z: z["dd"],
    )
    first = F.get("a", F.lit(0))
    gain = F.when((F.size("a") == period) & (first > 0), ratio("close", first) - 1)
    return stages(bars, {"a": F.collect_list("close").over(frame(period))}, {"dd": worst}, {"value": F.tanh(ratio(gain, F.when(F.col("dd") > 1e-8, F.col("dd"))))})


@indicator
def vr2_atr_close_zscore(bars: DataFrame, atr_period: int = 14, zscore_window: int = 60) -> DataFrame:
    base = atr(bars, atr_period).withColumnRenamed("value", "range")
    return stages(base, {"x": ratio("range", positive(F.col("close")))}, {"value": -F.tanh(zscore("x", zscore_window, atr_period))}).drop("range")


@indicator
def vr2_return_skew_risk_premium(bars: DataFrame, period: int = 40) -> DataFrame:
    """Skewness of log returns by the sample deviation, negated and saturated."""
    factor = ((period - 1) / period) ** 1.5
    steps = {"k": rolling(F.skewness, "r", period), "s": rolling(F.stddev_samp, "r", period)}
    return stages(bars, {"r": F.log(positive(ratio(positive(F.col("close")), lag("close"))))}, steps, {"value": F.when(F.col("s") > 1e-10, -F.tanh(F.col("k") * factor))})


# ---- mean reversion


@indicator
def mr_quantile_deviation(bars: DataFrame, period: int = 60, q: float = 0.5) -> DataFrame:
    spread = rolling(F.max, "close", period) - rolling(F.min, "close", period)
    return stages(bars, {"q": rolling(lambda x: F.percentile(x, F.lit(q)), "close", period), "s": spread}, {"value": -ratio(F.col("close") - F.col("q"), "s")})


@indicator
def mr_return_autocorr(bars: DataFrame, period: int = 20, lag_by: int = 5) -> DataFrame:
    """Correlation of log returns with those `lag_by` bars before, negated."""
    whole = row_no() >= period + lag_by
    return stages(bars, {"r": F.log(positive(ratio("close", lag("close"))))}, {"p": lag("r", lag_by)}, {"value": F.when(whole, -rolling_correlation("r", "p", period, period // 2))})


@indicator
def mr_tail_extreme(bars: DataFrame, period: int = 60, k: float = 2.0) -> DataFrame:
    """A log return's distance from its mean in deviations, negated: what exceeds k of them, else a third part."""
    m, s = rolling(F.avg, "r", period, period // 2), rolling(F.stddev_pop, "r", period, period // 2)
    z = F.when(row_no() > period, ratio(F.col("r") - m, F.when(s >= 1e-10, s)))
    return stages(bars, {"r": F.log(positive(ratio("close", lag("close"))))}, {"z": z}, {"value": -F.when(F.abs("z") > k, F.signum("z") * (F.abs("z") - k)).otherwise(F.col("z") * 0.3)})


@indicator
def mr_price_volume_divergence(bars: DataFrame, period: int = 20) -> DataFrame:
    """Difference of the window ranks of price and volume, negated."""
    share = lambda a, x: F.size(F.filter(a, lambda y: y <= F.col(x))) / period
    return stages(bars, {"a": F.collect_list("close").over(frame(period)), "b": F.collect_list("volume").over(frame(period))}, {"value": F.when(F.size("a") == period, -(share("a", "close") - share("b", "volume")))})


@indicator
def mr_vwap_deviation(bars: DataFrame, period: int = 20) -> DataFrame:
    steps = {"w": ratio(rolling(F.sum, F.col("close") * F.col("volume"), period), rolling(F.sum, "volume", period))}
    return stages(bars, steps, {"value": -ratio(F.col("close") - F.col("w"), "w")})


# ---- trend and momentum factors


@indicator
def tm_multi_window_momentum_fusion(bars: DataFrame, short: int = 10, mid: int = 21, long: int = 63) -> DataFrame:
    a, b, d = F.col("a"), F.col("b"), F.col("d")
    return stages(bars, {"a": change("close", short), "b": change("close", mid), "d": change("close", long)}, {"value": F.signum(a) * F.signum(b) * F.signum(d) * (a + b + d) / 3})


@indicator
def tm_momentum_jerk(bars: DataFrame, period: int = 10) -> DataFrame:
    return stages(bars, {"m": change("close", period)}, {"value": F.tanh(F.col("m") - lag("m", 1) * 3 + lag("m", 2) * 3 - lag("m", 3))})


@indicator
def tm_trend_persistence_weighted(bars: DataFrame, period: int = 20, lookback: int = 60) -> DataFrame:
    up = F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))
    return stages(bars, {"r": change()}, {"u": up}, {"x": (rolling(F.avg, "u", period) * 2 - 1) * change("close", period)}, {"value": clip(zscore_or_null("x", lookback, period), -3, 3)})


@indicator
def tm_log_return_skew_momentum(bars: DataFrame, period: int = 20) -> DataFrame:
    return stages(bars, {"r": F.log(positive(ratio("close", lag("close"))))}, {"value": rolling(F.skewness, "r", period) * rolling(F.avg, "r", period)})


@indicator
def tm_path_curvature_momentum(bars: DataFrame, period: int = 20) -> DataFrame:
    return stages(bars, {"y": F.log(positive(F.col("close")))}, {"d": F.col("y") - lag("y", 1) * 2 + lag("y", 2)}, {"value": F.tanh(-rolling(F.var_samp, "d", period)) * F.signum(F.col("y") - lag("y", period))})


@indicator
def tm_up_down_volume_asymmetry_momentum(bars: DataFrame, period: int = 20) -> DataFrame:
    up = F.when(F.col("r").isNotNull(), F.when(F.col("r") > 0, F.col("volume")).otherwise(0.0))
    all_ = F.when(F.col("r").isNotNull(), F.col("volume"))
    return stages(bars, {"r": change()}, {"u": up, "w": all_}, {"value": (ratio(rolling(F.sum, "u", period), rolling(F.sum, "w", period)) * 2 - 1) * change("close", period)})


@indicator
def tm_momentum_dispersion_reversal(bars: DataFrame, period: int = 20, lookback: int = 60) -> DataFrame:
    v = F.col("v")
    steps = {"x": F.tanh(ratio(F.lit(1.0), F.sqrt(F.when(v > 1e-12, v)))) * F.col("m")}
    return stages(
        bars, {"r": F.log(positive(ratio("close", lag("close"))))}, {"v": rolling(F.var_samp, "r", period), "m": rolling(F.avg, "r", period)}, steps,
        {"value": clip(zscore_or_null("x", lookback, period), -3, 3)},
    )


@indicator
def tm2_ema_slope_acceleration(bars: DataFrame, fast: int = 10, slow: int = 30, slope_period: int = 5) -> DataFrame:
    """Slope of the fast exponential mean less that of the slow one, saturated."""
    rows = smoothed(bars, {"a_": ("close", 2 / (fast + 1)), "b_": ("close", 2 / (slow + 1))})
    slope = lambda x: (F.col(x) - lag(x, slope_period)) / slope_period
    return stages(rows, {"value": F.tanh(slope("a_") - slope("b_"))}).drop("a_", "b_")


@indicator
def tm2_trend_information_ratio(bars: DataFrame, period: int = 25) -> DataFrame:
    """Slope of the log close over its residuals' deviation."""
    steps = {"s": rolling2(F.regr_slope, "y", "t", period), "e": F.sqrt(F.greatest(1 - rolling2(F.regr_r2, "y", "t", period), F.lit(0.0)) * rolling(F.var_samp, "y", period))}
    return stages(bars, {"t": row_no(), "y": F.log(positive(F.col("close")))}, steps, {"value": F.tanh(ratio("s", "e"))})


@indicator
def tm2_higher_moment_trend_health(bars: DataFrame, period: int = 30, lookback: int = 120) -> DataFrame:
    """Skewness less half the excess kurtosis, times the mean return; the moments are 0 where returns do not vary."""
    still = rolling(F.stddev_pop, "r", period) <= 1e-10
    shape = F.when(still, 0.0).otherwise(rolling(F.skewness, "r", period) - rolling(F.kurtosis, "r", period) * 0.5)
    return stages(bars, {"r": F.log(positive(ratio("close", lag("close"))))}, {"x": shape * rolling(F.avg, "r", period)}, {"value": clip(zscore_or_null("x", lookback, period), -3, 3)})


@indicator
def tm2_breakout_persistence_momentum(bars: DataFrame, period: int = 20, slope_period: int = 20) -> DataFrame:
    """Share of bars at their window's high, times the slope of the log close; a bar without a whole window is no breakout."""
    flag = F.coalesce((F.col("close") >= F.col("top")).cast("double"), F.lit(0.0))
    return stages(bars, {"t": row_no(), "y": F.log(positive(F.col("close"))), "top": rolling(F.max, "close", period)}, {"f": flag}, {"value": rolling(F.avg, "f", period) * rolling2(F.regr_slope, "y", "t", slope_period)})


# ---- volume


@indicator
def vl_volume_price_corr_reversal(bars: DataFrame, period: int = 20) -> DataFrame:
    return stages(bars, {"r": change(), "q": change("volume")}, {"value": -F.tanh(rolling_correlation("r", "q", period))})


@indicator
def vl_volume_quantile_momentum(bars: DataFrame, period: int = 60, short: int = 5) -> DataFrame:
    share = F.size(F.filter("a", lambda x: x <= F.col("s"))) / period
    return stages(bars, {"s": rolling(F.avg, "volume", short)}, {"a": F.collect_list("s").over(frame(period))}, {"value": F.when(F.size("a") == period, share - 0.5)})


@indicator
def vl_volume_concentration_herfindahl(bars: DataFrame, period: int = 20) -> DataFrame:
    total = rolling(F.sum, "volume", period)
    return stages(bars, {"s": rolling(F.sum, F.col("volume") * F.col("volume"), period), "t": total}, {"value": -ratio("s", F.col("t") * F.col("t"))})


@indicator
def vl_up_day_volume_share(bars: DataFrame, period: int = 20) -> DataFrame:
    """Share of the volume that fell on rising bars, less one half; the first bar rises not."""
    up = F.when(F.col("close") > lag("close"), F.col("volume")).when(F.col("volume").isNotNull(), 0.0)
    return stages(bars, {"u": up}, {"value": ratio(rolling(F.sum, "u", period), rolling(F.sum, "volume", period)) - 0.5})


@indicator
def vl_amihud_illiquidity_inverse(bars: DataFrame, period: int = 20) -> DataFrame:
    return stages(bars, {"x": ratio(F.abs(change()), F.col("volume") * F.col("close"))}, {"m": rolling(F.avg, "x", period)}, {"value": F.log(positive(ratio(F.lit(1.0), "m")))})


@indicator
def vl_volume_acceleration(bars: DataFrame, period: int = 10) -> DataFrame:
    return stages(bars, {"y": F.log(positive(F.col("volume")))}, {"m": rolling(F.avg, "y", period)}, {"value": F.col("m") - lag("m", 1) * 2 + lag("m", 2)})


@indicator
def vl_price_volume_divergence(bars: DataFrame, period: int = 20) -> DataFrame:
    """Standardised slope of the log volume less that of the log price."""
    steps = {"a": rolling2(F.regr_slope, "y", "t", period), "b": rolling2(F.regr_slope, "v", "t", period)}
    logs = {"t": row_no(), "y": F.log(positive(F.col("close"))), "v": F.log(positive(F.col("volume")))}
    return stages(bars, logs, steps, {"value": -(zscore_or_null("a", period * 3, period, 0.0) - zscore_or_null("b", period * 3, period, 0.0))})


@indicator
def mr_hilbert_phase(bars: DataFrame, period: int = 20) -> DataFrame:
    """Minus the sine of the phase of the last of `period` closes about their line, from bar period + 4 on.

    The transform looks two bars either way, so at the window's last bar its imaginary part is 0 and the
    phase 0 or pi: the value is 0 up to rounding wherever the window is whole.
    """
    rows = bars.withColumns({"t_": row_no()}).withColumns({"b_": rolling2(F.regr_slope, "close", "t_", period), "m_": rolling(F.avg, "close", period)})
    left = F.col("close") - F.col("m_") - F.col("b_") * (period - 1) / 2
    return rows.withColumn("value", F.when(F.col("t_") >= period + 4, F.lit(0.0) - F.sin(F.atan2(F.lit(0.0), left)))).drop("t_", "b_", "m_")


@indicator
def mr_fractal_dim(bars: DataFrame, period: int = 30) -> DataFrame:
    """Higuchi's fractal dimension of the last `period` closes, less 1.5; null outside (0.5, 2.5) and before 2 * period bars.

    The curve's length at step k is a weighted sum of the window's moves over k bars; minus the slope of its
    logarithm on that of k is the dimension. By this scale alternating closes have 1 and a straight line 0,
    which is outside and so null.
    """
    w = F.collect_list("close").over(frame(period))

    def length(k: int):
        weights = [(period - 1) / (k * k * ((period - 1 - i % k) // k)) for i in range(k, period)]
        moves = F.transform(F.sequence(F.lit(k), F.lit(period - 1)), lambda i: F.abs(F.get("w", i) - F.get("w", i - k)))
        return F.aggregate(F.zip_with(moves, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    steps = range(1, min(5, period // 4) + 1)
    ready = (F.size("w") == period) & (row_no() >= 2 * period)
    logs = {f"y{k}": F.when(F.col("ready") & (F.col(f"l{k}") > 0), F.ln(f"l{k}")) for k in steps}
    total = lambda term: sum((F.when(F.col(f"y{k}").isNotNull(), term(F.col(f"y{k}"), math.log(k))).otherwise(0.0) for k in steps), F.lit(0.0))
    n, sx, sy, sxx, sxy = (total(t) for t in (lambda y, x: F.lit(1.0), lambda y, x: F.lit(x), lambda y, x: y, lambda y, x: F.lit(x * x), lambda y, x: y * x))
    dim = -ratio(n * sxy - sx * sy, F.when(n >= 2, n * sxx - sx * sx))
    return stages(
        bars, {"w": w}, {"ready": ready}, {f"l{k}": F.when(F.col("ready"), length(k)) for k in steps}, logs, {"dim": dim},
        {"value": F.when((F.col("dim") > 0.5) & (F.col("dim") < 2.5), F.col("dim") - 1.5)},
    )
