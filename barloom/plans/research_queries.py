"""Queries over research statistics, with their SQL for DuckDB where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.oracle import BRAND_WEEK, avg_rank, change, div, lead, roll
from barloom.operators import portfolio as pf
from barloom.operators import research as rs
from barloom.plans.panel_queries import DAILY, FACTORS, held, rounded, week
from barloom.sources import panels

NAMES = ["momentum_score", "ma_gap_reversal_score", "volatility_score", "vl_volume_concentration_herfindahl"]


def expanding_folds(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rs.expanding_folds(panels.brand_bars(spark, folder).select("eob").distinct(), 100, 50, 5))


def screen_indicators(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rs.screen(panels.brand_bars(spark, folder), NAMES))


def parameter_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rs.sweep(panels.brand_bars(spark, folder), "momentum_score", "lookback", [5, 10, 20]))


def rolling_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rs.rolling_metrics(pf.daily_result(held(spark, folder)), "ret", (52, 104)), 5)


def deflated_sharpe(spark: SparkSession, folder: str) -> DataFrame:
    return rs.deflated_sharpe(pf.daily_result(held(spark, folder)), "ret", 20)


def overfitting(spark: SparkSession, folder: str) -> DataFrame:
    """Each brand's weekly change stands for a candidate."""
    rows = week(spark, folder).select(F.col("symbol").alias("candidate"), "eob", F.col("fwd").alias("ret")).where("ret IS NOT NULL")
    return rounded(rs.overfitting(rows, 6))


def regression_attribution(spark: SparkSession, folder: str) -> DataFrame:
    return rs.regression_attribution(week(spark, folder), FACTORS, "fwd")


def walk_forward_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rs.walk_forward(week(spark, folder), FACTORS, "fwd", 100, 26, 3)


def _ic_sql(key: str, parts: str) -> str:
    by = f"{key}, eob"
    return f"""WITH {BRAND_WEEK}, f AS (SELECT *, {div(lead('close', 2), lead('close', 1))} - 1 AS fwd, {change()} AS r FROM bars), c AS ({parts}),
k AS (SELECT {by}, {avg_rank('x', by)} AS a, {avg_rank('fwd', by)} AS b FROM c WHERE x IS NOT NULL AND fwd IS NOT NULL),
d AS (SELECT {by}, CASE WHEN isnan(corr(a, b)) THEN NULL ELSE corr(a, b) END AS ic FROM k GROUP BY ALL HAVING count(*) >= 5)
SELECT {key}, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS ic_ir, round(avg(CASE WHEN ic > 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS positive, count(ic) AS n FROM d GROUP BY {key}"""


_SUM, _SQUARE = roll("sum", "volume", 20), roll("sum", "(volume * volume)", 20)
_VALUES = {
    "momentum_score": change("close", 20), "ma_gap_reversal_score": f"-({div('close', roll('avg', 'close', 20))} - 1)",
    "volatility_score": f"-{roll('stddev_samp', 'r', 20)}", "vl_volume_concentration_herfindahl": f"-({_SQUARE} / nullif({_SUM} * {_SUM}, 0))",
}

QUERIES = {f.__name__: f for f in (expanding_folds, screen_indicators, parameter_sweep, rolling_metrics, deflated_sharpe, overfitting, regression_attribution, walk_forward_scores)}
ORACLE_SQL = {
    "expanding_folds": f"WITH {BRAND_WEEK}, p AS (SELECT eob, row_number() OVER (ORDER BY eob) - 1 AS p FROM (SELECT DISTINCT eob FROM bars)) SELECT CAST(floor((p - 100) / 50.0) AS BIGINT) AS fold, min(eob) AS test_start, max(eob) AS test_end, count(*) AS test_days, min(p) - 5 AS train_days FROM p WHERE p >= 100 GROUP BY 1",
    "screen_indicators": _ic_sql("indicator", " UNION ALL ".join(f"SELECT '{n}' AS indicator, symbol, eob, fwd, {e} AS x FROM f" for n, e in _VALUES.items())),
    "parameter_sweep": _ic_sql("lookback", " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS lookback, symbol, eob, fwd, {change('close', k)} AS x FROM f" for k in (5, 10, 20))),
    "rolling_metrics": f"WITH {DAILY}, rw AS (" + " UNION ALL ".join(f"SELECT {n} AS w, CASE WHEN count(ret) OVER f >= {n} THEN avg(ret) OVER f / nullif(stddev_samp(ret) OVER f, 0) * sqrt(252) END AS sharpe, CASE WHEN count(ret) OVER f >= {n} THEN avg(ret) OVER f * 252 END AS r FROM daily WINDOW f AS (ORDER BY eob ROWS {n - 1} PRECEDING)" for n in (52, 104)) + ') SELECT CAST(w AS BIGINT) AS "window", round(avg(sharpe), 5) AS sharpe_mean, round(min(sharpe), 5) AS sharpe_min, round(max(sharpe), 5) AS sharpe_max, round(avg(r), 5) AS return_mean, count(sharpe) AS n FROM rw GROUP BY w',
}
