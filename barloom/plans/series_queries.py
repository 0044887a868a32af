"""Queries over single series, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.oracle import NATION_MONTH
from barloom.operators import series as sr
from barloom.plans.panel_queries import rounded
from barloom.sources import panels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


_STEP = 10 / (sr.GRID - 1) / sr.FINE
_FEATURES = """CASE WHEN peak_height > 0.5 THEN 'fat_tail' WHEN peak_height < -0.5 THEN 'thin_tail' ELSE 'near_normal' END AS tail_feature,
CASE WHEN peak_position > 0.2 THEN 'right_skew' WHEN peak_position < -0.2 THEN 'left_skew' ELSE 'symmetric' END AS skew_feature"""


def _density_sql(source: str, lags: tuple[int, ...], select: str) -> str:
    """source: CTE p with symbol, eob and the log price p."""
    return f"""WITH {source}, l AS (SELECT unnest({list(lags)}) AS lag), o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY eob) AS t FROM p),
r AS (SELECT a.symbol, CAST(l.lag AS INTEGER) AS lag, a.p - b.p AS r FROM o a JOIN l ON true JOIN o b ON b.symbol = a.symbol AND b.t = a.t - l.lag),
st AS (SELECT symbol, lag, count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM r GROUP BY ALL HAVING stddev_samp(r) > 0),
mo AS (SELECT symbol, lag, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) - 3 AS kurt, avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5) AS skew FROM r JOIN st USING (symbol, lag) GROUP BY ALL),
z AS (SELECT symbol, lag, ((r - m) / sd + 5) / {_STEP!r} AS v FROM r JOIN st USING (symbol, lag)),
h AS (SELECT symbol, lag, b, sum(w) AS w FROM (SELECT symbol, lag, floor(v) AS b, 1 - (v - floor(v)) AS w FROM z UNION ALL SELECT symbol, lag, floor(v) + 1, v - floor(v) FROM z) GROUP BY ALL),
d AS (SELECT symbol, lag, n, g.range AS g, coalesce(sum(w * exp(-0.5 * pow((g.range * {sr.FINE} - b) * {_STEP!r} / pow(n, -0.2), 2))) / (n * pow(n, -0.2) * sqrt(2 * pi())), 0) AS y
FROM st JOIN range({sr.GRID}) g ON true JOIN h USING (symbol, lag) GROUP BY symbol, lag, n, g.range),
k AS (SELECT *, lag(y) OVER s AS a, lead(y) OVER s AS c FROM d WINDOW s AS (PARTITION BY symbol, lag ORDER BY g)),
x AS (SELECT symbol, lag, any_value(n) AS n, max(y) AS peak_height, -5 + 10 * arg_max(g, (y, -g)) / {float(sr.GRID - 1)} AS peak_position, count(*) FILTER (y > a AND y > c AND y >= {sr.LEAST_PEAK}) AS num_peaks FROM k GROUP BY symbol, lag)
SELECT {select}, CAST(lag AS BIGINT) AS lag, n, round(peak_height, 6) AS peak_height, round(peak_position, 6) AS peak_position, num_peaks, round(kurt, 6) AS statistical_kurtosis, round(skew, 6) AS statistical_skewness, {_FEATURES} FROM x JOIN mo USING (symbol, lag)"""


@query(_density_sql(f"{NATION_MONTH}, p AS (SELECT symbol, eob, ln(close) AS p FROM bars WHERE close > 0)", tuple(range(1, 35)), "symbol"))
def density_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Kernel densities of every nation's returns over 1 to 34 months."""
    return rounded(sr.density_shapes(panels.nation_bars(spark, folder)))


_LAGS = (1, 2, 3, 5)


@query(_density_sql(
    f"{NATION_MONTH}, q AS (SELECT 'quarter' AS period, symbol, date_trunc('quarter', eob) AS q0, arg_max(close, eob) AS close FROM bars GROUP BY ALL UNION ALL SELECT 'month', symbol, date_trunc('month', eob), arg_max(close, eob) FROM bars GROUP BY ALL),"
    " p AS (SELECT period || '/' || symbol AS symbol, q0 AS eob, ln(close) AS p FROM q WHERE close > 0)",
    _LAGS, "split_part(symbol, '/', 1) AS period, split_part(symbol, '/', 2) AS symbol",
))
def density_by_period(spark: SparkSession, folder: str) -> DataFrame:
    periods = {k: F.date_trunc(k, "eob") for k in ("month", "quarter")}
    return rounded(sr.by_period(panels.nation_bars(spark, folder), periods, lags=_LAGS))


def _hurst_sql(source: str, low: int, high: int) -> str:
    """source: CTE p with symbol, eob and the log price p."""
    return f"""WITH {source}, d AS (SELECT symbol, eob, p - lag(p) OVER (PARTITION BY symbol ORDER BY eob) AS r FROM p), r AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY eob) AS t FROM d WHERE r IS NOT NULL),
c AS (SELECT symbol, count(*) AS n, least({high}, (count(*) + 1) // 2) AS most FROM r GROUP BY symbol),
w AS (SELECT s.symbol, l.range AS l, s.t AS s, b.t, b.r, avg(b.r) OVER g AS m, stddev_samp(b.r) OVER g AS sd FROM r s JOIN c USING (symbol) JOIN range({low}, {high + 1}) l ON l.range <= most AND n > most AND s.t + l.range - 1 <= n
JOIN r b ON b.symbol = s.symbol AND b.t BETWEEN s.t AND s.t + l.range - 1 WINDOW g AS (PARTITION BY s.symbol, l.range, s.t)),
y AS (SELECT symbol, l, s, sd, sum(r - m) OVER (PARTITION BY symbol, l, s ORDER BY t) AS y FROM w),
v AS (SELECT symbol, l, avg(rs) AS rs FROM (SELECT symbol, l, (max(y) - min(y)) / any_value(sd) AS rs FROM y GROUP BY symbol, l, s HAVING any_value(sd) > 1e-14) GROUP BY symbol, l)
SELECT c.symbol, round(CASE WHEN count(l) >= 3 THEN regr_slope(ln(rs), ln(l)) END, 6) AS hurst, count(l) AS lags, any_value(n) + 1 AS n FROM c LEFT JOIN v USING (symbol) GROUP BY c.symbol"""


@query(_hurst_sql(f"{NATION_MONTH}, p AS (SELECT symbol, eob, ln(close) AS p FROM bars WHERE close > 0)", 10, 100))
def hurst_exponents(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sr.hurst(panels.nation_bars(spark, folder)))


@query()
def recent_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Exponent and unit-root tests over each nation's last 20, 40 and 60 months."""
    return rounded(sr.recent_windows(panels.nation_bars(spark, folder)))


@query()
def yearly_windows(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sr.recent_windows(panels.brand_bars(spark, folder), (30, 50), by_year=True))
