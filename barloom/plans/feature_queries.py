"""Queries over feature tables, symbol forms, stored factor tests and multiple tests, with their SQL for DuckDB."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import features as ft
from barloom.functions.indicators import mr_fractal_dim as fractal_dim
from barloom.functions.oracle import BRAND_WEEK, change, div, lag, log, over, roll
from barloom.operators import attribution as at
from barloom.operators import research as rs
from barloom.plans.panel_queries import NATION, nation, rounded
from barloom.sources import panels, store


def logdiff_features(spark: SparkSession, folder: str) -> DataFrame:
    out = ft.logdiff_features(panels.brand_bars(spark, folder), ("open", "close"), (1, 3), (0, 5))
    return rounded(out.drop("open", "high", "low", "close", "volume"))


def price_volume_features(spark: SparkSession, folder: str) -> DataFrame:
    out = ft.price_volume_features(panels.brand_bars(spark, folder), 2)
    return rounded(out.drop("open", "high", "low", "close", "volume"))


def ind_mr_fractal_dim(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(fractal_dim(panels.brand_bars(spark, folder)).select("symbol", "eob", "value"))


def symbol_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Both forms of symbols made of every exchange, an unknown one and no exchange at all, with futures' leading contracts."""
    names = F.array(*[F.lit(f"{p}.") for p in ft.EXCHANGES], F.lit("XX."), F.lit(""))
    code = F.concat(F.lit("RB"), F.when(F.col("p_partkey") % 5 == 0, "99").otherwise((F.col("p_partkey") % 2400).cast("string")))
    symbol = F.concat(F.get(names, (F.col("p_partkey") % 12).cast("int")), code)
    rows = panels.table(spark, folder, "part").select("p_partkey", symbol.alias("symbol")).withColumn("suffixed", ft.to_suffixed(F.col("symbol")))
    return rows.withColumn("back", ft.to_prefixed(F.col("suffixed")))


def _tested(spark: SparkSession, folder: str) -> DataFrame:
    """Factor tests by namespace, made of orders: each status tests each priority."""
    x = (F.col("o_orderkey") % 97 - 48) / F.lit(100.0)
    rows = panels.table(spark, folder, "orders").select(F.col("o_orderstatus").alias("namespace"), F.col("o_orderpriority").alias("factor_id"), x.alias("x"))
    ir = F.try_divide(F.avg("x"), F.stddev_samp("x"))
    return rows.groupBy("namespace", "factor_id").agg(
        F.avg("x").alias("IC_mean"), ir.alias("IC_IR"), (ir * F.sqrt(F.count("x"))).alias("t_stat"), (F.max("x") - F.min("x")).alias("long_short_return"),
    )


def best_factors(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(store.best_factors(_tested(spark, folder), "O", 0.01))


def factor_across_namespaces(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(store.across_namespaces(_tested(spark, folder), "1-URGENT"))


def adjusted_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Step-up adjusted p values, one test a brand: the share of its parts of a size up to 5."""
    tests = panels.table(spark, folder, "part").groupBy("p_brand").agg(F.round(F.avg(F.when(F.col("p_size") <= 5, 1.0).otherwise(0.0)), 6).alias("p_value"))
    return rounded(at.benjamini_hochberg(tests))


def neutral_score(spark: SparkSession, folder: str) -> DataFrame:
    """Momentum of each nation less its region's mean."""
    return rounded(rs.neutral_score(nation(spark, folder), "mom").select("symbol", "eob", "category", "value"))


def _table(features: dict[str, str], stages: list[dict[str, str]], warm: dict[str, str]) -> str:
    """Features over staged columns, rounded; rows with a missing one go."""
    text, last = [BRAND_WEEK], "bars"
    for i, stage in enumerate(stages):
        text.append(f"s{i} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {last})")
        last = f"s{i}"
    whole = features | warm
    text.append(f"z AS (SELECT symbol, eob, {', '.join(f'{e} AS {n}' for n, e in whole.items())} FROM {last})")
    return f"WITH {', '.join(text)} SELECT symbol, eob, {', '.join(f'round({n}, 6) AS {n}' for n in whole)} FROM z WHERE {' AND '.join(f'{n} IS NOT NULL' for n in whole)}"


def _diffs(factors: tuple[str, ...], lags: tuple[int, ...], shifts: tuple[int, ...]) -> tuple[list[dict[str, str]], dict[str, str]]:
    """The differences as stages: logs, unshifted differences; and each of those shifted."""
    pairs = list(product(factors, factors, lags))
    stages = [{f"g_{f}": log(f) for f in factors}, {f"d_{a}_{b}{k}": f"g_{a} - {lag(f'g_{b}', k)}" for a, b, k in pairs}]
    return stages, {f"logdiff_{a}_{b}{k}_shift{s}": lag(f"d_{a}_{b}{k}", s) if s else f"d_{a}_{b}{k}" for a, b, k in pairs for s in shifts}


_SOME, _SOME_OUT = _diffs(("open", "close"), (1, 3), (0, 5))
_ALL, _ALL_OUT = _diffs(ft.PRICES, (1, 2, 3, 4, 5), (0, 1))
_SPANS = (10, 20, 40, 60, 120, 160)
_MORE = (
    {f"return_{k}": change("close", k) for k in (1, 2, 3, 5, 10, 20, 40, 60, 120, 160)} | {f"ma_gap_{k}": f"{div('close', roll('avg', 'close', k))} - 1" for k in _SPANS}
    | {f"volatility_{k}": roll("stddev_samp", "r1", k) for k in _SPANS} | {"intraday_return": f"{div('close', 'open')} - 1", "high_low_range": f"{div('high', 'low')} - 1", "volume_change_5": change("volume", 5)}
)
_FORMS = ", ".join(f"('{p}', '{s}', {p in ft.FUTURES})" for p, s in ft.EXCHANGES.items())
_NAMES = ", ".join(f"'{p}.'" for p in (*ft.EXCHANGES, "XX")) + ", ''"
_TESTS = """t AS (SELECT o_orderstatus AS namespace, o_orderpriority AS factor_id, (o_orderkey % 97 - 48) / 100.0::DOUBLE AS x FROM orders),
q AS (SELECT namespace, factor_id, avg(x) AS IC_mean, avg(x) / nullif(stddev_samp(x), 0) AS IC_IR, avg(x) / nullif(stddev_samp(x), 0) * sqrt(count(x)) AS t_stat, max(x) - min(x) AS long_short_return FROM t GROUP BY ALL)"""
_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in ("IC_mean", "IC_IR", "t_stat", "long_short_return"))

QUERIES = {
    f.__name__: f
    for f in (logdiff_features, price_volume_features, ind_mr_fractal_dim, symbol_forms, best_factors, factor_across_namespaces, adjusted_tests, neutral_score)
}
ORACLE_SQL = {
    "logdiff_features": _table(_SOME_OUT, _SOME, {}),
    "price_volume_features": _table(_ALL_OUT, [*_ALL, {"r1": change()}], _MORE),
    "ind_mr_fractal_dim": f"""WITH {BRAND_WEEK}, s AS (SELECT symbol, eob, list(close) OVER {over(30)} AS w, row_number() OVER {over()} AS t FROM bars),
p AS (SELECT symbol, eob, w, unnest([1, 2, 3, 4, 5]) AS k FROM s WHERE t >= 60),
l AS (SELECT symbol, eob, k, list_sum(list_transform(range(k, 30), lambda i: abs(w[i + 1] - w[i + 1 - k]) * 29.0::DOUBLE / (k * k * ((29 - i % k) // k)))) AS l FROM p),
d AS (SELECT symbol, eob, -regr_slope(ln(l), ln(k)) AS dim FROM l WHERE l > 0 GROUP BY ALL HAVING count(*) >= 2)
SELECT symbol, eob, round(CASE WHEN dim > 0.5 AND dim < 2.5 THEN dim - 1.5 END, 6) AS value FROM bars LEFT JOIN d USING (symbol, eob)""",
    "symbol_forms": f"""WITH x AS (SELECT p_partkey, [{_NAMES}][p_partkey % 12 + 1] AS pre, CASE WHEN p_partkey % 5 = 0 THEN '99' ELSE CAST(p_partkey % 2400 AS VARCHAR) END AS num FROM part),
e(p, s, fut) AS (VALUES {_FORMS})
SELECT p_partkey, concat(pre, 'RB', num) AS symbol, CASE WHEN s IS NULL THEN concat(pre, 'RB', num) WHEN fut AND num LIKE '%99' THEN concat('RB', num[:-3], '_DOMINANT.', s) ELSE concat('RB', num, '.', s) END AS suffixed,
concat(pre, 'RB', num) AS back FROM x LEFT JOIN e ON pre = p || '.'""",
    "best_factors": f"WITH {_TESTS} SELECT factor_id, {_ROUND} FROM q WHERE namespace = 'O' AND abs(IC_IR) > 0.01",
    "factor_across_namespaces": f"WITH {_TESTS} SELECT namespace, {_ROUND} FROM q WHERE factor_id = '1-URGENT'",
    "adjusted_tests": """WITH t AS (SELECT p_brand, round(avg(CASE WHEN p_size <= 5 THEN 1.0 ELSE 0.0 END), 6) AS p_value FROM part GROUP BY 1),
c AS (SELECT a.p_brand, a.p_value, b.p_value * (SELECT count(*) FROM t) / (SELECT count(*) FROM t u WHERE u.p_value <= b.p_value) AS q FROM t a JOIN t b ON b.p_value >= a.p_value)
SELECT p_brand, round(p_value, 6) AS p_value, round(least(min(q), 1.0), 6) AS adjusted FROM c GROUP BY p_brand, p_value""",
    "neutral_score": f"WITH {NATION} SELECT symbol, eob, category, round(mom - avg(mom) OVER (PARTITION BY eob, category), 6) AS value FROM nm",
}
