"""One query for each indicator, over weekly brand bars, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.functions.oracle import BRAND_WEEK, change, clip, div, lag, log, over, roll, roll2, steps, zscore
from barloom.sources import panels

Query = Callable[[SparkSession, str], DataFrame]


#: Digits after the point; compounded slopes are so large that more would be noise.
DIGITS = {"trend_score_v2": 0}


def query(name: str, **params: object) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = ind.INDICATORS[name](panels.brand_bars(spark, folder), **params)
        return out.select("symbol", "eob", F.round("value", DIGITS.get(name, 6)).alias("value"))

    return run


ROW = f"CAST(row_number() OVER {over()} AS DOUBLE)"
Y = {"t": ROW, "y": log("close")}
R = {"r": change()}
LR = {"r": log(div("close", lag("close")))}


def corr_guard(y: str, x: str, n: int, least: int | None = None) -> str:
    """corr, null where a side hardly varies."""
    both = f"{y} IS NOT NULL AND {x} IS NOT NULL"
    a, b = f"(CASE WHEN {both} THEN {y} END)", f"(CASE WHEN {both} THEN {x} END)"
    spread = " AND ".join(f"stddev_pop({c}) OVER {over(n)} > 1e-10" for c in (a, b))
    return f"(CASE WHEN {spread} THEN {roll2('corr', y, x, n, least)} END)"


def z_or_null(x: str, n: int, least: int, tiny: str = "1e-8") -> str:
    std = roll("stddev_samp", x, n, least)
    return f"(({x} - {roll('avg', x, n, least)}) / (CASE WHEN {std} > {tiny} THEN {std} END))"


def ema(x: str, alpha: float, out: str, start: str) -> tuple[str, str]:
    """CTEs for a recursive mean seeded at the first value of each symbol."""
    rows = f"{out}_r AS (SELECT *, row_number() OVER (PARTITION BY symbol, {x} IS NULL ORDER BY eob) AS rn_ FROM {start})"
    walk = (
        f"{out}_w AS (SELECT symbol, rn_, {x} AS {out} FROM {out}_r WHERE {x} IS NOT NULL AND rn_ = 1 UNION ALL "
        f"SELECT n.symbol, n.rn_, p.{out} * (1 - {alpha!r}) + n.{x} * {alpha!r} FROM {out}_w p JOIN {out}_r n ON n.symbol = p.symbol AND n.rn_ = p.rn_ + 1 AND n.{x} IS NOT NULL)"
    )
    joined = f"{out}_j AS (SELECT r.* EXCLUDE (rn_), w.{out} FROM {out}_r r LEFT JOIN {out}_w w ON w.symbol = r.symbol AND w.rn_ = r.rn_ AND r.{x} IS NOT NULL)"
    return ", ".join((rows, walk, joined)), f"{out}_j"


def sql(*stages: dict[str, str], value: str) -> str:
    return steps(BRAND_WEEK, *stages, {"value": value}, select="symbol, eob, round(value, 6) AS value")


def sql_ema(before: list[dict[str, str]], emas: list[tuple[str, float, str]], after: list[dict[str, str]], value: str) -> str:
    text, last = [BRAND_WEEK.strip()], "bars"
    for i, stage in enumerate(before):
        text.append(f"b{i} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {last})")
        last = f"b{i}"
    for x, alpha, out in emas:
        part, last = ema(x, alpha, out, last)
        text.append(part)
    return steps(", ".join(text), *after, {"value": value}, select="symbol, eob, round(value, 6) AS value", start=last)


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
UP = "(CASE WHEN r IS NOT NULL THEN CASE WHEN r > 0 THEN volume ELSE 0.0 END END)"
DOWN = "(CASE WHEN r IS NOT NULL THEN least(r, 0.0) END)"


def safe(x: str, y: str, fill: float = 0.0) -> str:
    return f"coalesce({div(x, y)}, {fill})"


def members(a: str, x: str) -> str:
    return f"len(list_filter({a}, lambda e: e <= {x}))"


def window_list(x: str, n: int) -> str:
    return f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {over(n)}"


SKEW = "(CASE WHEN stddev_pop({x}) OVER {w} > 0 THEN (avg({x}*{x}*{x}) OVER {w} - 3*avg({x}) OVER {w}*avg({x}*{x}) OVER {w} + 2*pow(avg({x}) OVER {w},3)) / pow(stddev_pop({x}) OVER {w},3) END)"


def skew(x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER {over(n)} >= {n} THEN {SKEW.format(x=x, w=over(n))} END)"


def kurt(x: str, n: int) -> str:
    return roll("kurtosis_pop", x, n)


SPECS: dict[str, tuple[dict[str, object], str | None]] = {
    "roc": ({}, sql({"x": "close"}, value=change("x", 20))),
    "ma": ({}, sql({"m": roll("avg", "close", 5)}, value=safe("close - m", "m"))),
    "daily_return": ({}, sql(value=change())),
    "ma_cross": ({}, sql(value=f"{roll('avg', 'close', 5)} - {roll('avg', 'close', 20)}")),
    "price_above_ma": ({}, sql(value=f"close - {roll('avg', 'close', 20)}")),
    "bias_momentum": ({}, sql({"t": ROW, "b": div("close", roll("avg", "close", 90))}, value=roll2("regr_slope", "b", "t", 25))),
    "mom_skip": ({}, sql(value=f"{div(lag('close', 22), lag('close', 252))} - 1")),
    "trend_score": ({}, sql(Y, value=f"{roll2('regr_slope', 'y', 't', 25)} * 252 * {roll2('regr_r2', 'y', 't', 25)}")),
    "trend_score_v2": ({}, sql(Y, {"s": roll2("regr_slope", "y", "t", 25), "q": f"coalesce({roll2('regr_r2', 'y', 't', 25)}, 0)"}, value="(exp(s * 250) - 1) * q")),
    "trend_score_v2_skip": ({"period": 120}, sql({"t": ROW, "z": lag("close", 22)}, {"y": log("z")}, {"s": roll2("regr_slope", "y", "t", 98), "q": f"coalesce({roll2('regr_r2', 'y', 't', 98)}, 0)"}, value="(exp(s * 250) - 1) * q")),
    "plain_trend_score": ({}, sql(Y, value=f"{roll2('regr_slope', 'y', 't', 60)} * 252")),
    "momentum_score": ({}, sql(value=change("close", 20))),
    "mean_reversion_score": ({}, sql(value=f"-{div('close - ' + roll('avg', 'close', 20), roll('stddev_samp', 'close', 20))}")),
    "ma_gap_reversal_score": ({}, sql(value=f"-({div('close', roll('avg', 'close', 20))} - 1)")),
    "asset_class_momentum_score": ({}, sql(value=f"({change('close', 20)} + {change('close', 60)} + {change('close', 120)}) / 3")),
    "er": ({}, sql({"d": f"abs(close - {lag('close')})", "e": f"abs(close - {lag('close', 14)})"}, value=safe("e", roll("sum", "d", 14)))),
    "cci": ({}, sql({"x": "(high + low + close) / 3"}, {"m": roll("avg", "x", 20), "a": window_list("x", 20)}, value=div("x - m", "list_sum(list_transform(a, lambda e: abs(e - m))) / 20 * 0.015"))),
    "rsi": ({}, sql({"d": f"coalesce(close - {lag('close')}, 0)"}, {"g": roll("avg", "greatest(d, 0)", 14), "s": roll("avg", "greatest(-d, 0)", 14)}, value=f"coalesce(100 - 100 / (1 + {div('g', 's')}), 50)")),
    "simple_rsi": ({}, sql({"d": f"close - {lag('close')}"}, {"u": "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", "w": "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END"}, value=f"coalesce(100 - 100 / (1 + {div(roll('avg', 'u', 14), roll('avg', 'w', 14))}), 50)")),
    "williams_r": ({}, sql({"top": roll("max", "high", 14), "bottom": roll("min", "low", 14), "p": lag("close", 13)}, {"x": f"({safe('top - close', 'top - bottom', 0.5)} * -100 + 50) * (1 - 0.5 * abs(tanh((CASE WHEN p = 0 THEN 0 ELSE {div('close - p', 'p')} END) * 20)))"}, {"z": zscore("x", 60, 14)}, value=clip("z", -3, 3))),
    "orb_relvol": ({}, sql({"m": roll("avg", "volume", 14, 1)}, {"p": lag("m")}, value=safe("volume", "p", 1.0))),
    "slowkdj": ({}, sql({"r": safe(f"close - {roll('min', 'low', 14)}", f"{roll('max', 'high', 14)} - {roll('min', 'low', 14)}", 0.5) + " * 100", "mo": change("close", 14)}, {"k": roll("avg", "r", 3)}, {"d": roll("avg", "k", 3)}, {"x": "((300 - k - d - (3 * k - 2 * d)) / 3 - 50) * (1 + 0.3 * tanh(mo * 10))"}, {"z": zscore("x", 60, 14)}, value=clip("z", -3, 3))),
    "rsi_divergence": ({}, sql({"d": f"coalesce(close - {lag('close')}, 0)", "r": change(), "t": ROW}, {"strength": f"100 - 100 / (1 + {safe(roll('avg', 'greatest(d, 0)', 14), roll('avg', 'greatest(-d, 0)', 14), 1.0)})", "s": roll("stddev_samp", "r", 14)}, {"a": roll2("regr_slope", "close", "t", 20), "b": roll2("regr_slope", "strength", "t", 20), "usual": roll("avg", "s", 60)}, {"x": f"(-a * b * 0.6 + 0.4 * (CASE WHEN strength > 70 THEN -(strength - 70) / 30 WHEN strength < 30 THEN (30 - strength) / 30 ELSE 0 END)) * sqrt({safe('s', 'usual', 1.0)})"}, {"z": zscore("x", 60, 14)}, value=clip("z", -3, 3))),
    "donchian_channel": ({}, sql_ema([{"top": roll("max", "high", 20), "bottom": roll("min", "low", 20)}, {"w": "top - bottom"}, {"usual": roll("avg", "w", 40, 20)}, {"x": f"0.4 * 2 * ({safe('close - bottom', 'w', 0.5)} - 0.5) + 0.3 * {safe('(CASE WHEN w IS NOT NULL THEN greatest(close - top, 0) + least(close - bottom, 0) END)', 'w')} + 0.2 * {safe('close - (top + bottom) / 2', 'w')} + 0.1 * tanh(2 - {safe('w', 'usual', 1.0)})"}, {"z": zscore("x", 60, 20)}], [("z", 0.1, "e")], [], clip("e", -3, 3))),
    "atr": ({}, sql_ema([{"tr": TR}], [("tr", 1 / 14, "e")], [], "e")),
    "close_atr_proxy": ({}, sql_ema([{"d": f"abs(close - {lag('close')})"}], [("d", 1 / 14, "e")], [{"n": "count(d) OVER (PARTITION BY symbol ORDER BY eob)"}], "CASE WHEN n >= 14 THEN e END")),
    "volatility_score": ({}, sql(R, value=f"-{roll('stddev_samp', 'r', 20)}")),
    "realized_volatility": ({}, sql(LR, value=f"{roll('stddev_samp', 'r', 20)} * sqrt(252)")),
    "vr_downside_semivariance_premium": ({}, sql(R, {"d": "CASE WHEN r < 0 THEN r ELSE 0 END"}, {"s": roll("avg", "d * d", 20)}, value="tanh(1 / sqrt(CASE WHEN s > 1e-12 THEN s END))")),
    "vr_vol_quantile_rank": ({}, sql(R, {"s": roll("stddev_samp", "r", 10)}, {"a": window_list("s", 120)}, value=f"CASE WHEN len(a) >= 120 THEN -{members('a', 's')} / CAST(len(a) AS DOUBLE) END")),
    "vr_vol_mean_reversion_speed": ({}, sql(R, {"s": roll("stddev_samp", "r", 20)}, {"p": lag("s", 5)}, {"k": f"-{corr_guard('s', 'p', 20)}"}, value=clip("k", -1, 1))),
    "vr_up_down_vol_asymmetry": ({}, sql(R, {"u": "CASE WHEN r > 0 THEN r * r ELSE 0.0 END", "d": "CASE WHEN r < 0 THEN r * r ELSE 0.0 END", "nu": "CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END", "nd": "CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END"}, {"a": f"sqrt({div(roll('sum', 'u', 20), roll('sum', 'nu', 20))})", "b": f"sqrt({div(roll('sum', 'd', 20), roll('sum', 'nd', 20))})"}, value="CASE WHEN a > 1e-10 AND b > 1e-10 THEN tanh(ln(a) - ln(b)) END")),
    "vr_var_tail_risk_inverse": ({}, sql(R, {"q": roll("quantile_cont({x}, 0.05)", "r", 60)}, value=f"tanh({div('1.0', 'abs(q)')})")),
    "vr_vol_clustering_autocorr": ({}, sql({"r": f"abs({change()})"}, {"p": lag("r")}, {"k": f"-{corr_guard('r', 'p', 20)}"}, value=clip("k", -1, 1))),
    "vr2_sortino_downside_momentum": ({}, sql(R, {"d": DOWN}, {"m": roll("avg", "r", 20), "s": f"sqrt({roll('avg', 'd * d', 20)})"}, value=f"tanh({div('m', 'CASE WHEN s > 1e-10 THEN s END')})")),
    "vr2_vol_term_structure_tanh": ({}, sql(R, {"a": roll("stddev_samp", "r", 10), "b": roll("stddev_samp", "r", 60)}, {"z": zscore("b", 120, 60)}, value=f"tanh({div('a', 'b')} - 1) * -0.6 - tanh(z) * 0.4")),
    "vr2_calmar_risk_adjusted": ({}, sql({"a": window_list("close", 60)}, {"dd": "list_max(list_transform(range(1, len(a) + 1), lambda i: 1 - a[i] / list_max(a[1:i])))"}, value="CASE WHEN len(a) = 60 AND a[1] > 0 AND dd > 1e-8 THEN tanh((close / a[1] - 1) / dd) END")),
    "vr2_atr_close_zscore": ({}, sql_ema([{"tr": TR}], [("tr", 1 / 14, "e")], [{"x": div("e", "close")}, {"z": zscore("x", 60, 14)}], "-tanh(z)")),
    "vr2_return_skew_risk_premium": ({}, sql(LR, {"k": skew("r", 40), "s": roll("stddev_samp", "r", 40)}, value=f"CASE WHEN s > 1e-10 THEN -tanh(k * {((40 - 1) / 40) ** 1.5!r}) END")),
    "vr_hurst_regime_persistence": ({}, sql({"y": log("close")}, {"m": roll("avg", "y", 100), "s": roll("stddev_samp", "y", 100), "a": window_list("y", 100)}, {"c": "list_transform(range(1, len(a) + 1), lambda i: list_sum(list_transform(a[1:i], lambda e: e - m)))"}, {"h": f"CASE WHEN m IS NOT NULL AND s > 1e-12 THEN {log('((list_max(c) - list_min(c)) / nullif(s, 0))')} / ln(100) - 0.5 END"}, value=clip("h", -0.5, 0.5))),
    "mr_quantile_deviation": ({}, sql({"q": roll("quantile_cont({x}, 0.5)", "close", 60), "s": f"{roll('max', 'close', 60)} - {roll('min', 'close', 60)}"}, value=f"-{div('close - q', 's')}")),
    "mr_return_autocorr": ({}, sql({"r": LR["r"], "t": ROW}, {"p": lag("r", 5)}, value=f"CASE WHEN t >= 25 THEN -{corr_guard('r', 'p', 20, 10)} END")),
    "mr_tail_extreme": ({}, sql({"r": LR["r"], "t": ROW}, {"m": roll("avg", "r", 60, 30), "s": roll("stddev_pop", "r", 60, 30)}, {"z": "CASE WHEN t > 60 AND s >= 1e-10 THEN (r - m) / s END"}, value="-(CASE WHEN abs(z) > 2 THEN sign(z) * (abs(z) - 2) ELSE z * 0.3 END)")),
    "mr_price_volume_divergence": ({}, sql({"a": window_list("close", 20), "b": window_list("volume", 20)}, value=f"CASE WHEN len(a) = 20 THEN -({members('a', 'close')} / 20.0 - {members('b', 'volume')} / 20.0) END")),
    "mr_vwap_deviation": ({}, sql({"w": div(roll("sum", "(close * volume)", 20), roll("sum", "volume", 20))}, value=f"-{div('close - w', 'w')}")),
    "tm_multi_window_momentum_fusion": ({}, sql({"a": change("close", 10), "b": change("close", 21), "d": change("close", 63)}, value="sign(a) * sign(b) * sign(d) * (a + b + d) / 3")),
    "tm_momentum_jerk": ({}, sql({"m": change("close", 10)}, value=f"tanh(m - {lag('m')} * 3 + {lag('m', 2)} * 3 - {lag('m', 3)})")),
    "tm_trend_persistence_weighted": ({}, sql(R, {"u": "CASE WHEN r IS NOT NULL THEN CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END END"}, {"x": f"({roll('avg', 'u', 20)} * 2 - 1) * {change('close', 20)}"}, {"z": z_or_null("x", 60, 20)}, value=clip("z", -3, 3))),
    "tm_log_return_skew_momentum": ({}, sql(LR, value=f"{skew('r', 20)} * {roll('avg', 'r', 20)}")),
    "tm_path_curvature_momentum": ({}, sql({"y": log("close")}, {"d": f"y - {lag('y')} * 2 + {lag('y', 2)}", "p": lag("y", 20)}, value=f"tanh(-{roll('var_samp', 'd', 20)}) * sign(y - p)")),
    "tm_up_down_volume_asymmetry_momentum": ({}, sql(R, {"u": UP, "w": "CASE WHEN r IS NOT NULL THEN volume END"}, value=f"({div(roll('sum', 'u', 20), roll('sum', 'w', 20))} * 2 - 1) * {change('close', 20)}")),
    "tm_momentum_dispersion_reversal": ({}, sql(LR, {"v": roll("var_samp", "r", 20), "m": roll("avg", "r", 20)}, {"x": "tanh(1 / sqrt(CASE WHEN v > 1e-12 THEN v END)) * m"}, {"z": z_or_null("x", 60, 20)}, value=clip("z", -3, 3))),
    "tm2_ema_slope_acceleration": ({}, sql_ema([], [("close", 2 / 11, "a"), ("close", 2 / 31, "b")], [{"p": lag("a", 5), "q": lag("b", 5)}], "tanh((a - p) / 5 - (b - q) / 5)")),
    "tm2_trend_information_ratio": ({}, sql(Y, {"s": roll2("regr_slope", "y", "t", 25), "e": f"sqrt(greatest(1 - {roll2('regr_r2', 'y', 't', 25)}, 0) * {roll('var_samp', 'y', 25)})"}, value=f"tanh({div('s', 'e')})")),
    "tm2_higher_moment_trend_health": ({}, sql(LR, {"sd": roll("stddev_pop", "r", 30), "k": skew("r", 30), "q": kurt("r", 30), "m": roll("avg", "r", 30)}, {"x": "(CASE WHEN sd <= 1e-10 THEN 0 ELSE k - q * 0.5 END) * m"}, {"z": z_or_null("x", 120, 30)}, value=clip("z", -3, 3))),
    "tm2_breakout_persistence_momentum": ({}, sql(Y, {"top": roll("max", "close", 20)}, {"f": "CASE WHEN top IS NOT NULL AND close >= top THEN 1.0 ELSE 0.0 END"}, value=f"{roll('avg', 'f', 20)} * {roll2('regr_slope', 'y', 't', 20)}")),
    "vl_volume_price_corr_reversal": ({}, sql({"r": change(), "q": change("volume")}, value=f"-tanh({corr_guard('r', 'q', 20)})")),
    "vl_volume_quantile_momentum": ({}, sql({"s": roll("avg", "volume", 5)}, {"a": window_list("s", 60)}, value=f"CASE WHEN len(a) = 60 THEN {members('a', 's')} / 60.0 - 0.5 END")),
    "vl_volume_concentration_herfindahl": ({}, sql({"s": roll("sum", "(volume * volume)", 20), "t": roll("sum", "volume", 20)}, value=f"-{div('s', 't * t')}")),
    "vl_up_day_volume_share": ({}, sql({"p": lag("close")}, {"u": "CASE WHEN close > p THEN volume ELSE 0.0 END"}, value=f"{div(roll('sum', 'u', 20), roll('sum', 'volume', 20))} - 0.5")),
    "vl_amihud_illiquidity_inverse": ({}, sql({"x": div(f"abs({change()})", "volume * close")}, {"m": roll("avg", "x", 20)}, value=log("(1.0 / nullif(m, 0))"))),
    "vl_volume_acceleration": ({}, sql({"y": log("volume")}, {"m": roll("avg", "y", 10)}, value=f"m - {lag('m')} * 2 + {lag('m', 2)}")),
    "vl_price_volume_divergence": ({}, sql({"t": ROW, "y": log("close"), "v": log("volume")}, {"a": roll2("regr_slope", "y", "t", 20), "b": roll2("regr_slope", "v", "t", 20)}, value=f"-({z_or_null('a', 60, 20, '0')} - {z_or_null('b', 60, 20, '0')})")),
}

def _supertrend() -> str:
    """A walk over the bands, sides and ages of each symbol, then windows."""
    head, last = ema("tr", 1 / 14, "a", "t0")
    bands = f"""m0 AS (SELECT *, {roll('avg', 'a', 28, 14)} AS m FROM {last}), m1 AS (SELECT *, 2 * (0.8 + 0.4 * tanh({safe('a', 'm', 1.0)} - 1)) * a AS wd FROM m0),
rn AS (SELECT *, (high + low) / 2 + wd AS u, (high + low) / 2 - wd AS l, row_number() OVER {over()} AS rn FROM m1)"""
    walk = """wk AS (SELECT symbol, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS tp, 0.0::DOUBLE AS bt, CAST(NULL AS INT) AS side, CAST(0 AS BIGINT) AS age, 0.0::DOUBLE AS pc FROM (SELECT DISTINCT symbol FROM rn) UNION ALL
SELECT symbol, rn, tp, bt, side, CASE WHEN side IS NULL OR side IS DISTINCT FROM was THEN 1 ELSE old + 1 END, close FROM (SELECT *, CASE WHEN rn <= 14 THEN NULL WHEN close <= bt THEN -1 WHEN close >= tp THEN 1 ELSE was END AS side
FROM (SELECT n.symbol, n.rn, n.close, p.side AS was, p.age AS old, CASE WHEN n.rn <= 14 OR n.u < p.tp OR p.pc > p.tp THEN n.u ELSE p.tp END AS tp, CASE WHEN n.rn <= 14 OR n.l > p.bt OR p.pc < p.bt THEN n.l ELSE p.bt END AS bt
FROM wk p JOIN rn n ON n.symbol = p.symbol AND n.rn = p.rn + 1)))"""
    line = "(CASE side WHEN 1 THEN bt WHEN -1 THEN tp END)"
    place, aged = f"({safe('close - bt', 'tp - bt', 0.5)} - 0.5) * 2", clip("ln(1 + age) / ln(15)", 0.1, 2.0)
    raw = f"{safe(f'close - {line}', line)} * 0.4 * side + {place} * 0.3 + {aged} * 0.2 * side + tanh({safe('v', 'vm', 1.0)}) * 0.1 * side"
    rest = f"""w0 AS (SELECT rn.*, tp, bt, side, age, {change()} AS r FROM rn JOIN wk USING (symbol, rn)), w1 AS (SELECT *, {roll('stddev_samp', 'r', 14)} AS v FROM w0), w2 AS (SELECT *, {roll('avg', 'v', 28)} AS vm FROM w1),
w3 AS (SELECT *, {raw} AS x FROM w2), w4 AS (SELECT *, CASE WHEN count(x) OVER {over(60)} >= 14 THEN {zscore('x', 60, 14)} END AS z FROM w3)"""
    tail, last = ema("z", 0.15, "e", "w4")
    return f"WITH RECURSIVE {BRAND_WEEK}, t0 AS (SELECT *, {TR} AS tr FROM bars), {head}, {bands}, {walk}, {rest}, {tail} SELECT symbol, eob, round({clip('e', -3, 3)}, 6) AS value FROM {last}"


SPECS["mr_hilbert_phase"] = ({}, sql({"t": ROW}, {"e": f"close - {roll('avg', 'close', 20)} - {roll2('regr_slope', 'close', 't', 20)} * 9.5"}, value="CASE WHEN t >= 24 THEN 0.0 - sin(atan2(0.0, e)) END").replace("round(value, 6)", "round(value, 6) + 0.0"))
SPECS["supertrend"] = ({}, _supertrend())

QUERIES: dict[str, Query] = {f"ind_{name}": query(name, **params) for name, (params, _) in SPECS.items()}
ORACLE_SQL: dict[str, str] = {f"ind_{name}": text.replace("round(value, 6)", f"round(value, {DIGITS.get(name, 6)})") for name, (_, text) in SPECS.items() if text}
