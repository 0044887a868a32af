"""Queries over cross-sections, markets, portfolios and attribution, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.oracle import BRAND_WEEK, EVENT_DAY, NATION_MONTH, avg_rank, change, div, lag, lead, over, pct_rank, roll, steps
from barloom.functions.windows import change as changed, first_rank, ratio, rolling, series
from barloom.operators import attribution as at
from barloom.operators import cross_section as cs
from barloom.operators import market as mk
from barloom.operators import portfolio as pf
from barloom.session import cut
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


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for a comparison of values across engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# ---- panels with factors: week panel (25 brands), month panel with categories (25 nations)


def week(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly bars with three factors and the next executable return."""
    bars = panels.brand_bars(spark, folder)
    bars = bars.withColumns({"mom": changed("close", 5), "gap": -(ratio("close", rolling(F.avg, "close", 10)) - 1), "vol": rolling(F.avg, "volume", 4)})
    return bars.withColumn("fwd", cs.forward_return())


FWD = f"({div(lead('close', 2), lead('close', 1))} - 1)"
WEEK = {"mom": change("close", 5), "gap": f"-({div('close', roll('avg', 'close', 10))} - 1)", "vol": roll("avg", "volume", 4), "fwd": FWD}
FACTORS = ["mom", "gap", "vol"]


def first(x: str, by: str = "eob") -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {x} DESC NULLS LAST, symbol)"


def held(spark: SparkSession, folder: str) -> DataFrame:
    """Dense small weights (a small part of the capital) of the five best of momentum, on the calendar of the week panel."""
    rows = cut(week(spark, folder))  # the grid of dates and symbols, the picks and the bars all come from it
    picks = cs.top_n(rows, "mom", 5, 0.002).select("symbol", "eob", "weight")
    dense = mk.densified(picks, rows.select("eob").distinct(), rows.select("symbol").distinct())
    return dense.join(rows.drop("weight"), ["symbol", "eob"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


HELD = f"""{BRAND_WEEK}, f AS (SELECT *, {WEEK['mom']} AS mom FROM bars),
picks AS (SELECT symbol, eob, 0.002 / count(*) OVER (PARTITION BY eob) AS weight FROM (SELECT *, {first('mom')} AS p FROM f WHERE mom IS NOT NULL) WHERE p <= 5),
held AS (SELECT d.eob, s.symbol, coalesce(p.weight, 0) AS weight, b.open, b.high, b.low, b.close, b.volume FROM (SELECT DISTINCT eob FROM bars) d
  CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN picks p USING (eob, symbol) LEFT JOIN bars b USING (eob, symbol))"""

DAILY = f"""{HELD}, w AS (SELECT *, coalesce({lag('weight')}, 0) AS w, {div(lead('close'), 'close')} - 1 AS f FROM held),
t AS (SELECT *, abs(w - coalesce({lag('w')}, 0)) AS t FROM w),
daily0 AS (SELECT eob, sum(w * f) AS gross, sum(t) AS turnover FROM t GROUP BY eob HAVING sum(w * f) IS NOT NULL),
daily AS (SELECT *, turnover * 0.0004 AS cost, gross - turnover * 0.0004 AS ret FROM daily0),
eq0 AS (SELECT *, product(1 + ret) OVER (ORDER BY eob ROWS UNBOUNDED PRECEDING) AS equity FROM daily),
eq1 AS (SELECT *, max(equity) OVER (ORDER BY eob ROWS UNBOUNDED PRECEDING) AS high FROM eq0), eq AS (SELECT *, 1 - equity / high AS drawdown FROM eq1)"""


# ---- cross-section


@query(f"""WITH {EVENT_DAY}, x AS (SELECT *, {change('close', 5)} AS fac, {FWD} AS fwd FROM bars),
k AS (SELECT eob, {avg_rank('fac')} AS a, {avg_rank('fwd')} AS b FROM x WHERE fac IS NOT NULL AND fwd IS NOT NULL)
SELECT eob, round(corr(a, b), 6) AS ic, count(*) AS n FROM k GROUP BY eob HAVING count(*) >= 5""")
def ic_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily rank IC of 5-bar momentum against the next executable return."""
    bars = panels.event_day_bars(spark, folder)
    return rounded(cs.rank_ic(bars.withColumns({"fac": changed("close", 5), "fwd": cs.forward_return()}), "fac", "fwd"))


def _surface_sql() -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{f}' AS factor, {h} AS horizon, {g} AS lag, eob, symbol, {f} AS x, {div(lead('close', 1 + g + h), lead('close', 1 + g))} - 1 AS y FROM s0"
        for f in FACTORS for h in (1, 4) for g in (0, 2)
    )
    by = "factor, horizon, lag, eob"
    return steps(BRAND_WEEK, WEEK, select="factor, CAST(horizon AS BIGINT) AS horizon, CAST(lag AS BIGINT) AS lag, " + r("ic_mean", "ic_std", "ic_ir", "positive") + ", n", start="bars").replace(
        "SELECT factor,", f""", c AS ({cells}), k AS (SELECT {by}, {avg_rank('x', by)} AS a, {avg_rank('y', by)} AS b FROM c WHERE x IS NOT NULL AND y IS NOT NULL),
d AS (SELECT {by}, CASE WHEN isnan(corr(a, b)) THEN NULL ELSE corr(a, b) END AS ic FROM k GROUP BY ALL HAVING count(*) >= 5),
o AS (SELECT factor, horizon, lag, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / nullif(stddev_samp(ic), 0) AS ic_ir, avg(CASE WHEN ic > 1e-9 THEN 1.0 ELSE 0.0 END) AS positive, count(ic) AS n FROM d GROUP BY ALL)
SELECT factor,""").replace("FROM s0 \n", "FROM o").replace(" FROM s0 ", " FROM s0 ", 1)  # fmt: skip


@query()
def ic_surface(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cs.information_surface(week(spark, folder), FACTORS, [1, 4], [0, 2]))


_sql = _surface_sql().rstrip()
ORACLE_SQL["ic_surface"] = _sql[: _sql.rindex("FROM s0")] + "FROM o"


@query(f"""WITH {EVENT_DAY}, x AS (SELECT *, {change('close', 5)} AS fac, {FWD} AS fwd FROM bars),
k AS (SELECT eob, {avg_rank('fac')} AS a, {avg_rank('fwd')} AS b FROM x WHERE fac IS NOT NULL AND fwd IS NOT NULL),
i AS (SELECT eob, corr(a, b) AS ic FROM k GROUP BY eob HAVING count(*) >= 5), m AS (SELECT eob, ic - avg(ic) OVER () AS d, avg(ic) OVER () AS m FROM i),
g AS (SELECT *, d * lag(d, 1) OVER (ORDER BY eob) AS g1, d * lag(d, 2) OVER (ORDER BY eob) AS g2 FROM m),
v AS (SELECT max(m) AS mean, count(*) AS n, sum(d * d) / count(*) + 2 * (1 - 1 / 3.0) * coalesce(sum(g1), 0) / count(*) + 2 * (1 - 2 / 3.0) * coalesce(sum(g2), 0) / count(*) AS v FROM g)
SELECT round(mean, 6) AS mean, n, round(sqrt(v / n), 6) AS se, round(mean / nullif(sqrt(v / n), 0), 6) AS t FROM v""")
def ic_newey_west(spark: SparkSession, folder: str) -> DataFrame:
    bars = panels.event_day_bars(spark, folder)
    daily = cs.rank_ic(bars.withColumns({"fac": changed("close", 5), "fwd": cs.forward_return()}), "fac", "fwd")
    return rounded(cs.newey_west(daily, "ic", 2))


BUCKET = "least(floor((row_number() OVER (PARTITION BY eob ORDER BY mom, symbol) - 1) / greatest(floor(count(*) OVER (PARTITION BY eob) / 5), 1)) + 1, 5)"


@query(steps(BRAND_WEEK, WEEK, select="eob, bucket, round(avg(fwd), 6) AS mean_return, count(*) AS n", start="bars", tail="GROUP BY ALL").replace("FROM s0", f"FROM (SELECT *, CAST({BUCKET} AS BIGINT) AS bucket FROM s0 WHERE mom IS NOT NULL AND fwd IS NOT NULL)"))
def quantile_returns(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cs.group_returns(week(spark, folder), "mom", "fwd", 5))


@query(steps(BRAND_WEEK, WEEK, select="eob, bucket, round((len(list_filter(now, lambda e: NOT list_contains(was, e))) + len(list_filter(was, lambda e: NOT list_contains(now, e)))) / CAST(len(was) AS DOUBLE), 6) AS turnover", tail="WHERE was IS NOT NULL").replace(
    "FROM s0", f"FROM (SELECT eob, bucket, now, lag(now) OVER (PARTITION BY bucket ORDER BY eob) AS was FROM (SELECT eob, bucket, list(symbol) AS now FROM (SELECT *, CAST({BUCKET} AS BIGINT) AS bucket FROM s0 WHERE mom IS NOT NULL) GROUP BY ALL))"))
def quantile_turnover(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cs.group_turnover(week(spark, folder), "mom", 5))


_pairs = " UNION ALL ".join(f"SELECT '{a}' AS factor_a, '{b}' AS factor_b, eob, {a} AS x, {b} AS y FROM s0" for a, b in (("mom", "gap"), ("mom", "vol"), ("gap", "vol")))
_by = "factor_a, factor_b, eob"


@query(steps(BRAND_WEEK, WEEK, select=f"factor_a, factor_b, round(avg(ic), 6) AS correlation, count(ic) AS n FROM (SELECT {_by}, CASE WHEN isnan(corr(a, b)) THEN NULL ELSE corr(a, b) END AS ic FROM (SELECT {_by}, {avg_rank('x', _by)} AS a, {avg_rank('y', _by)} AS b FROM ({_pairs}) WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL --", start="bars").split(" -- FROM")[0])
def factor_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cs.factor_correlation(week(spark, folder), FACTORS))


_auto = " UNION ALL ".join(f"SELECT {p} AS period, eob, r, lag(r, {p}) OVER (PARTITION BY symbol ORDER BY eob) AS q FROM ra" for p in (1, 4))


@query(f"WITH {BRAND_WEEK}, s0 AS (SELECT *, {change('close', 5)} AS mom FROM bars), ra AS (SELECT symbol, eob, {avg_rank('mom')} AS r FROM s0 WHERE mom IS NOT NULL), c AS ({_auto}), k AS (SELECT period, eob, CASE WHEN isnan(corr(r, q)) THEN NULL ELSE corr(r, q) END AS k FROM c WHERE q IS NOT NULL GROUP BY ALL) SELECT CAST(period AS BIGINT) AS period, round(avg(k), 6) AS autocorrelation, count(k) AS n FROM k GROUP BY period")
def rank_autocorrelation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cs.rank_autocorrelation(week(spark, folder), "mom", [1, 4]))


@query(steps(BRAND_WEEK, WEEK, {"p": first("mom"), "q": first("gap")}, select="eob, round(CAST(count(*) FILTER (p <= 3 AND mom IS NOT NULL AND q <= 3 AND gap IS NOT NULL) AS DOUBLE) / nullif(count(*) FILTER ((p <= 3 AND mom IS NOT NULL) OR (q <= 3 AND gap IS NOT NULL)), 0), 6) AS jaccard", tail="GROUP BY eob"))
def topn_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cs.top_jaccard(week(spark, folder), "mom", "gap", 3))


_NORM = {f"n_{f}": pct_rank(f if d > 0 else f"(-{f})") for f, d in (("mom", 1), ("gap", 1), ("vol", -1))}


@query(steps(BRAND_WEEK, WEEK, _NORM, {"total": "coalesce(n_mom * 1.0, 0) + coalesce(n_gap * 1.0, 0) + coalesce(n_vol * 1.0, 0)", "there": "(n_mom IS NOT NULL)::INT + (n_gap IS NOT NULL)::INT + (n_vol IS NOT NULL)::INT"}, select="symbol, eob, round(total / nullif(there, 0), 6) AS score"))
def combined_score(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cs.combined_score(week(spark, folder), {"mom": 1, "gap": 1, "vol": -1}).select("symbol", "eob", "score"))


@query(f"WITH {HELD} SELECT symbol, eob, round(weight, 6) AS weight FROM picks")
def topn_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cs.top_n(week(spark, folder), "mom", 5, 0.002).select("symbol", "eob", "weight"))


def _vote(f: str) -> str:
    rank = f"(CASE WHEN {f} IS NOT NULL THEN rank() OVER (PARTITION BY eob, {f} IS NULL ORDER BY {f} DESC) + (count(*) OVER (PARTITION BY eob, {f}) - 1) / 2.0 END)"
    return f"(CASE WHEN {rank} <= greatest(floor(count({f}) OVER (PARTITION BY eob) * 0.3), 1) THEN 1 ELSE 0 END)"


@query(steps(BRAND_WEEK, WEEK, select=f"symbol, eob, CAST({' + '.join(map(_vote, FACTORS))} AS BIGINT) AS votes"))
def top_share_votes(spark: SparkSession, folder: str) -> DataFrame:
    return cs.votes(week(spark, folder), FACTORS, 0.3).select("symbol", "eob", F.col("votes").cast("bigint").alias("votes"))


@query(steps(BRAND_WEEK, WEEK, {"m": "quantile_cont(mom, 0.5) OVER (PARTITION BY eob)"}, {"d": "quantile_cont(abs(mom - m), 0.5) OVER (PARTITION BY eob) * 3"}, select="symbol, eob, round(CASE WHEN mom IS NOT NULL THEN greatest(least(mom, m + d), m - d) END, 6) AS value"))
def clip_mad(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cs.clip_mad(week(spark, folder), "mom", 3).select("symbol", "eob", "value"))


@query(steps(BRAND_WEEK, WEEK, {"m": "avg(mom) OVER (PARTITION BY eob)", "d": "stddev_samp(mom) OVER (PARTITION BY eob) * 2"}, select="symbol, eob, round(CASE WHEN mom IS NOT NULL THEN greatest(least(mom, m + d), m - d) END, 6) AS value"))
def winsorize_std(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cs.clip_std(week(spark, folder), "mom", 2).select("symbol", "eob", "value"))


@query(steps(BRAND_WEEK, WEEK, {"a": "quantile_cont(mom, 0.025) OVER (PARTITION BY eob)", "b": "quantile_cont(mom, 0.975) OVER (PARTITION BY eob)"}, select="symbol, eob, round(CASE WHEN mom IS NOT NULL THEN greatest(least(mom, b), a) END, 6) AS value"))
def winsorize_percentile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cs.clip_percentile(week(spark, folder), "mom").select("symbol", "eob", "value"))


# ---- labels


@query(steps(BRAND_WEEK, {"f": f"{div(lead('close', 4), 'close')} - 1"}, select="symbol, eob, CAST(CASE WHEN f > 0.02 THEN 1 WHEN f < -0.02 THEN -1 ELSE 0 END AS BIGINT) AS label"))
def forward_return_label(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(panels.brand_bars(spark, folder).select("symbol", "eob", cs.return_label(4, 0.02, 0.02).alias("label")))


@query(steps(BRAND_WEEK, {"a": f"list(close) OVER (PARTITION BY symbol ORDER BY eob ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)"}, {"t": "list_filter(list_transform(coalesce(a, []), lambda p: CASE WHEN p >= close * 1.1 THEN 1 WHEN p <= close * 0.9 THEN -1 END), lambda e: e IS NOT NULL)"}, select="symbol, eob, CAST(CASE WHEN len(coalesce(a, [])) < 6 THEN 0 ELSE coalesce(t[1], 0) END AS BIGINT) AS label"))
def triple_barrier(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cs.triple_barrier(panels.brand_bars(spark, folder), 0.1, 0.1, 6).select("symbol", "eob", "label"))


@query(f"WITH {BRAND_WEEK}, f AS (SELECT *, {div(lead('close', 4), 'close')} - 1 AS r FROM bars) SELECT symbol, eob, round({pct_rank('r')}, 6) AS label FROM f WHERE r IS NOT NULL")
def rank_labels(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cs.rank_labels(panels.brand_bars(spark, folder), 4).select("symbol", "eob", "label"))


# ---- market


@query(f"WITH {BRAND_WEEK} SELECT symbol, eob, open, high, low, close, volume FROM bars")
def bars_week(spark: SparkSession, folder: str) -> DataFrame:
    return panels.brand_bars(spark, folder)


@query(f"WITH {BRAND_WEEK}, q AS (SELECT *, {lag('eob')} = eob AS again FROM bars) SELECT symbol, count(*) AS rows, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS missing, count(*) FILTER (open <= 0 OR low <= 0) AS not_positive, count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS crossed, count(*) FILTER (again) AS repeated FROM q GROUP BY symbol")
def validate_ohlcv(spark: SparkSession, folder: str) -> DataFrame:
    return mk.validate(panels.brand_bars(spark, folder))


IDLE = "volume <= 60"
LAST = f"last_value(CASE WHEN NOT ({IDLE}) THEN close END IGNORE NULLS) OVER ({'PARTITION BY symbol ORDER BY eob'} ROWS UNBOUNDED PRECEDING)"


@query(f"WITH {BRAND_WEEK}, q AS (SELECT *, {LAST} AS traded_close FROM bars) SELECT symbol, eob, {r('close', 'traded_close')}, round(close / nullif(traded_close, 0) - 1, 6) AS jump FROM q WHERE {IDLE} AND abs(close / nullif(traded_close, 0) - 1) > 0.05")
def zero_volume_jumps(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mk.zero_volume_jumps(panels.brand_bars(spark, folder), 0.05, 60))


@query(f"WITH {BRAND_WEEK}, q AS (SELECT *, {LAST} AS l FROM bars) SELECT symbol, eob, {', '.join(f'CASE WHEN {IDLE} THEN coalesce(l, {c}) ELSE {c} END AS {c}' for c in ('open', 'high', 'low', 'close'))}, volume FROM q")
def repair_idle(spark: SparkSession, folder: str) -> DataFrame:
    return mk.repair_idle(panels.brand_bars(spark, folder), 60)


def _events(bars: DataFrame) -> DataFrame:
    """Split events: each quarter's second Monday-labelled bar of every symbol doubles the factor."""
    picks = bars.where((F.month("eob") % 3 == 0) & F.dayofmonth("eob").between(8, 14))
    order = F.row_number().over(series())
    return picks.select("symbol", "eob", F.lit(2.0).alias("factor"), F.pow(F.lit(2.0), F.least(order, F.lit(6))).alias("cum_factor"))


_EVENTS = "ev AS (SELECT symbol, eob, 2.0 AS factor, CAST(pow(2.0, least(row_number() OVER (PARTITION BY symbol ORDER BY eob), 6)) AS DOUBLE) AS cum FROM bars WHERE month(eob) % 3 = 0 AND day(eob) BETWEEN 8 AND 14)"


@query(f"WITH {BRAND_WEEK}, {_EVENTS}, e AS (SELECT symbol, arg_max(cum, eob) AS latest, arg_min(cum / factor, eob) AS f FROM ev GROUP BY symbol), j AS (SELECT b.*, coalesce(coalesce(a.cum, e.f) / e.latest, 1) AS ratio FROM bars b ASOF LEFT JOIN ev a ON a.symbol = b.symbol AND b.eob >= a.eob LEFT JOIN e ON e.symbol = b.symbol) SELECT symbol, eob, close * ratio AS close, volume / ratio AS volume, ratio FROM j")
def forward_adjust(spark: SparkSession, folder: str) -> DataFrame:
    bars = panels.brand_bars(spark, folder)
    return mk.forward_adjust(bars, _events(bars)).select("symbol", "eob", "close", "volume", "ratio")


_MIN = """m AS (SELECT event_type AS symbol, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS eob, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL), q AS (SELECT *, hour(eob) * 60 + minute(eob) AS mi FROM m),
a AS (SELECT *, CASE WHEN mi BETWEEN 571 AND 690 THEN 570 WHEN mi BETWEEN 781 AND 900 THEN 780 END AS anchor FROM q)"""


@query(f"WITH {_MIN} SELECT symbol, CAST(date_trunc('day', eob) AS TIMESTAMP) + to_minutes(CAST(anchor + (floor((mi - anchor - 1) / 5) + 1) * 5 AS BIGINT)) AS bar, round(arg_min(open, eob), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, eob), 6) AS close, round(sum(volume), 6) AS volume FROM a WHERE anchor IS NOT NULL AND volume > 0 GROUP BY ALL")
def resample_5m(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mk.resample_5m(panels.event_minute_bars(spark, folder)))


@query(f"WITH {BRAND_WEEK} SELECT symbol, CAST(date_trunc('month', eob) AS DATE) AS bar, round(arg_min(open, eob), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, eob), 6) AS close, round(sum(volume), 6) AS volume FROM bars GROUP BY ALL")
def resample_month(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mk.resample(panels.brand_bars(spark, folder), F.date_trunc("MONTH", "eob").cast("date")))


@query(f"WITH {BRAND_WEEK}, d AS (SELECT DISTINCT eob FROM bars) SELECT max(eob) AS eob FROM d GROUP BY date_trunc('month', eob)")
def rebalance_dates(spark: SparkSession, folder: str) -> DataFrame:
    return mk.last_dates(panels.brand_bars(spark, folder).select("eob").distinct(), "MONTH")


@query(f"WITH {HELD}, p AS (SELECT eob, row_number() OVER (ORDER BY eob) - 1 AS p FROM (SELECT DISTINCT eob FROM held)), k AS (SELECT h.symbol, h.eob, CASE WHEN p % 4 = 0 THEN weight END AS k FROM held h JOIN p USING (eob)) SELECT symbol, eob, round(coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY eob ROWS UNBOUNDED PRECEDING), 0), 6) AS weight FROM k")
def rebalance_hold(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mk.hold_every(held(spark, folder).select("symbol", "eob", "weight"), 4))


@query(f"WITH {BRAND_WEEK}, s AS (SELECT min(eob) AS a, max(eob) AS b FROM bars) SELECT round((year(b) - year(a)) * 12 + month(b) - month(a) + day(b) / CAST(day(last_day(b)) AS DOUBLE) - day(a) / CAST(day(last_day(a)) AS DOUBLE), 6) AS months FROM s")
def month_span(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(panels.brand_bars(spark, folder).agg(mk.month_span().alias("months")))


# ---- portfolio


@query(f"WITH {DAILY} SELECT eob, {r('gross', 'turnover', 'cost', 'ret')} FROM daily")
def backtest_daily(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pf.daily_result(held(spark, folder)))


@query(f"WITH {DAILY} SELECT eob, {r('equity', 'high', 'drawdown')} FROM eq")
def backtest_equity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pf.equity(pf.daily_result(held(spark, folder))).select("eob", "equity", "high", "drawdown"))


@query(f"""WITH {DAILY}, m AS (SELECT arg_max(equity, eob) AS l, max(drawdown) AS max_drawdown, avg(turnover) AS avg_turnover, sum(cost) AS total_cost, stddev_samp(ret) * sqrt(252) AS ann_volatility,
stddev_samp(least(ret, 0)) * sqrt(252) AS dn, count(*) AS days, count(*) FILTER (turnover > 1e-8) AS trade_days FROM eq), n AS (SELECT *, l - 1 AS total_return, pow(l, 252.0 / days) - 1 AS ann_return FROM m)
SELECT {r('total_return', 'ann_return', 'ann_volatility', 'max_drawdown', 'avg_turnover', 'total_cost')}, days, trade_days, round(ann_return / nullif(ann_volatility, 0), 6) AS sharpe, round(ann_return / nullif(dn, 0), 6) AS sortino, round(ann_return / nullif(max_drawdown, 0), 6) AS calmar FROM n""")
def backtest_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pf.metrics(pf.daily_result(held(spark, folder))))


@query(f"WITH {DAILY} SELECT CAST(year(eob) AS BIGINT) AS year, round(product(1 + ret) - 1, 6) AS year_return FROM daily GROUP BY 1")
def backtest_years(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pf.yearly_returns(pf.daily_result(held(spark, folder))))


@query(f"""WITH {DAILY}, h AS (SELECT *, CASE WHEN equity >= high THEN 1 ELSE 0 END AS nh FROM eq), i AS (SELECT *, sum(nh) OVER (ORDER BY eob ROWS UNBOUNDED PRECEDING) AS island FROM h),
u AS (SELECT island, max(drawdown) AS depth, arg_max(eob, (drawdown, -epoch(eob))) AS trough, count(*) AS days FROM i WHERE nh = 0 GROUP BY island), p AS (SELECT island, eob AS peak, lead(eob) OVER (ORDER BY eob) AS recovery FROM i WHERE nh = 1)
SELECT peak, trough, recovery, round(depth, 6) AS depth, days FROM u LEFT JOIN p USING (island) ORDER BY u.depth DESC, trough LIMIT 5""")
def drawdown_episodes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pf.drawdown_episodes(pf.daily_result(held(spark, folder))))


@query(f"WITH {HELD}, s AS (SELECT *, {change()} AS r FROM held), q AS (SELECT *, CASE WHEN weight > 0 THEN 1 / nullif({roll('stddev_samp', 'r', 20, 10)}, 0) END AS i FROM s) SELECT symbol, eob, round(coalesce(i / nullif(sum(i) OVER (PARTITION BY eob), 0), 0), 6) AS weight FROM q")
def risk_parity(spark: SparkSession, folder: str) -> DataFrame:
    rows = held(spark, folder).withColumnRenamed("weight", "picked")
    return rounded(pf.inverse_risk(rows, "picked", 20, 10).select("symbol", "eob", "weight"))


@query(f"WITH {HELD}, s AS (SELECT *, {change()} AS r FROM held), q AS (SELECT *, CASE WHEN weight > 0 THEN 1 / nullif({roll('var_samp', 'r', 20, 10)}, 0) END AS i FROM s) SELECT symbol, eob, round(coalesce(i / nullif(sum(i) OVER (PARTITION BY eob), 0), 0), 6) AS weight FROM q")
def inverse_variance(spark: SparkSession, folder: str) -> DataFrame:
    rows = held(spark, folder).withColumnRenamed("weight", "picked")
    return rounded(pf.inverse_risk(rows, "picked", 20, 10, 2).select("symbol", "eob", "weight"))


@query(f"WITH {BRAND_WEEK}, m AS (SELECT *, {roll('avg', 'close', 20, 10)} AS m FROM bars) SELECT eob, round(coalesce(sum(CASE WHEN close > m THEN 1.0 ELSE 0.0 END) / nullif(count(close), 0), 0.5), 6) AS breadth FROM m GROUP BY eob")
def market_breadth(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pf.breadth(panels.brand_bars(spark, folder)))


@query(f"WITH {HELD}, w AS (SELECT *, {lag('weight')} AS w, {change()} AS r FROM held), p AS (SELECT eob, sum(w * r) AS p FROM w GROUP BY eob), v AS (SELECT eob, CASE WHEN count(p) OVER f >= 20 THEN stddev_samp(p) OVER f * sqrt(252) END AS s FROM p WINDOW f AS (ORDER BY eob ROWS 59 PRECEDING)) SELECT eob, round(coalesce(least(1, 0.1 / nullif(s, 0)), 1), 6) AS scale FROM v")
def volatility_target(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pf.volatility_target(held(spark, folder)))


@query(f'WITH {BRAND_WEEK}, p AS (SELECT *, {lag("close")} AS p FROM bars) SELECT symbol, eob, CASE WHEN coalesce((p - open) / p > 0.02 OR (p - close) / p > 0.03, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "exit" FROM p')
def exit_gap_down(spark: SparkSession, folder: str) -> DataFrame:
    return pf.gap_down(panels.brand_bars(spark, folder)).select("symbol", "eob", "exit")


_SPIKE = f"coalesce({roll('stddev_samp', 'r', 10, 5)} / greatest({roll('stddev_samp', 'r', 60, 30)}, 1e-6), 1)"


@query(f'WITH {BRAND_WEEK}, p AS (SELECT *, {change()} AS r FROM bars) SELECT symbol, eob, round({_SPIKE}, 1) AS "exit" FROM p')
def exit_volatility_spike(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pf.volatility_spike(panels.brand_bars(spark, folder)).select("symbol", "eob", "exit"), 1)


@query(f'WITH {BRAND_WEEK}, p AS (SELECT *, coalesce({change()} < -0.0, false) AS l FROM bars), i AS (SELECT *, sum(CASE WHEN l THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY eob ROWS UNBOUNDED PRECEDING) AS g FROM p) SELECT symbol, eob, CAST(sum(CASE WHEN l THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, g ORDER BY eob ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS "exit" FROM i')
def exit_losing_run(spark: SparkSession, folder: str) -> DataFrame:
    return pf.losing_run(panels.brand_bars(spark, folder)).select("symbol", "eob", "exit")


@query(f'WITH {BRAND_WEEK} SELECT symbol, eob, round(coalesce(1 - close / nullif(max(close) OVER {over(20)}, 0), 0), 6) AS "exit" FROM bars')
def exit_drawdown(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pf.drawdown_from_high(panels.brand_bars(spark, folder)).select("symbol", "eob", "exit"))


@query(f'WITH {BRAND_WEEK}, p AS (SELECT *, {change()} AS r FROM bars), q AS (SELECT *, {_SPIKE} AS k FROM p), s AS (SELECT *, CASE WHEN k >= 1.3 THEN 1.0 WHEN k <= 0.9 THEN 0.0 END AS s FROM q) SELECT symbol, eob, CAST(coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY eob ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS "exit" FROM s')
def exit_hysteresis(spark: SparkSession, folder: str) -> DataFrame:
    return pf.hysteresis(panels.brand_bars(spark, folder), 1.3, 0.9).select("symbol", "eob", "exit")


@query()
def fsm_reversion_stop(spark: SparkSession, folder: str) -> DataFrame:
    return pf.reversion_stop(panels.brand_bars(spark, folder))


def limited(spark: SparkSession, folder: str) -> DataFrame:
    """Dense equal weights of the 3, 5 and 10 best of momentum as strategies; a symbol without a bar is suspended, a move of a tenth is its limit."""
    rows = week(spark, folder).withColumn("place", F.when(F.col("mom").isNotNull(), first_rank("mom"))).withColumn("move", changed("close", 1))
    dense = mk.densified(rows.select("symbol", "eob", "place", "move", "close"), rows.select("eob").distinct(), rows.select("symbol").distinct())
    strategies = F.array(*[F.struct(F.lit(f"top{n}").alias("strategy_id"), F.lit(n).alias("n")) for n in (3, 5, 10)])
    long = dense.withColumn("s", F.explode(strategies)).select("s.*", "symbol", "eob", "place", "move", "close")
    flags = {"suspended": F.col("close").isNull(), "limit_up": F.col("move") >= 0.1, "limit_down": F.col("move") <= -0.1}
    return long.withColumns(flags | {"weight": F.when(F.col("place") <= F.col("n"), 1 / F.col("n")).otherwise(0.0)})


@query()
def constrained_execution(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pf.constrained(limited(spark, folder)))


@query()
def shrunk_optimum(spark: SparkSession, folder: str) -> DataFrame:
    return pf.shrunk_optimum(week(spark, folder).withColumn("score", F.coalesce("mom", F.lit(0.0))))


# ---- attribution


def nation(spark: SparkSession, folder: str) -> DataFrame:
    bars = panels.nation_bars(spark, folder).withColumn("mom", changed("close", 3))
    place = F.when(F.col("mom").isNotNull(), first_rank("mom"))
    return bars.withColumn("weight", F.when(place <= 8, 0.125).otherwise(0.0)).withColumn("ret", ratio(F.lead("close").over(series()), F.col("close")) - 1)


NATION = f"{NATION_MONTH}, nm AS (SELECT *, {change('close', 3)} AS mom FROM bars), nation0 AS (SELECT *, CASE WHEN mom IS NOT NULL AND {first('mom')} <= 8 THEN 0.125 ELSE 0.0 END AS weight, {div(lead('close'), 'close')} - 1 AS ret FROM nm)"
PNL = f"{NATION}, pnl0 AS (SELECT *, abs(weight - coalesce({lag('weight')}, 0)) AS moved FROM nation0), pnl AS (SELECT *, weight * ret AS gross, moved * 0.0004 AS cost, weight * ret - moved * 0.0004 AS net FROM pnl0)"


@query(f"WITH {PNL} SELECT symbol, eob, category, {r('gross', 'cost', 'net')} FROM pnl")
def symbol_pnl(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(at.symbol_pnl(nation(spark, folder)).select("symbol", "eob", "category", "gross", "cost", "net"))


@query(f"WITH {PNL} SELECT eob, category, round(sum(gross), 6) AS gross, round(sum(cost), 6) AS cost, round(sum(net), 6) AS net FROM pnl GROUP BY ALL")
def category_pnl(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(at.category_pnl(at.symbol_pnl(nation(spark, folder))))


_NEUTRAL = "bm0 AS (SELECT eob, count(DISTINCT category) AS k FROM nation0 GROUP BY eob), bm AS (SELECT n.*, 1.0 / (k * count(*) OVER (PARTITION BY n.eob, category)) AS benchmark FROM nation0 n JOIN bm0 USING (eob))"


@query(f"WITH {NATION}, {_NEUTRAL} SELECT symbol, eob, round(benchmark, 6) AS benchmark FROM bm")
def category_neutral_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(at.category_neutral(nation(spark, folder)).select("symbol", "eob", "benchmark"))


@query(f"""WITH {NATION}, {_NEUTRAL}, b0 AS (SELECT eob, category, sum(weight) AS wp, sum(benchmark) AS wb, sum(weight * ret) / nullif(sum(weight), 0) AS rp0, sum(benchmark * ret) / nullif(sum(benchmark), 0) AS rb FROM bm GROUP BY ALL),
b1 AS (SELECT *, coalesce(rp0, rb) AS rp, sum(wb * rb) OVER (PARTITION BY eob) AS tot FROM b0) SELECT eob, category, round((wp - wb) * (rb - tot), 6) AS allocation, round(wb * (rp - rb), 6) AS selection, round((wp - wb) * (rp - rb), 6) AS interaction FROM b1""")
def brinson(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(at.brinson(at.category_neutral(nation(spark, folder))))


@query(f"""WITH {NATION}, a AS (SELECT *, coalesce({lag('weight')}, 0) AS before FROM nation0) SELECT symbol, eob, CASE WHEN before <= 1e-9 AND weight > 1e-9 THEN 'buy' WHEN before > 1e-9 AND weight <= 1e-9 THEN 'sell'
WHEN weight - before > 1e-9 THEN 'add' WHEN weight - before < -1e-9 THEN 'reduce' WHEN weight > 1e-9 THEN 'hold' ELSE 'none' END AS action FROM a""")
def action_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return at.actions(nation(spark, folder)).select("symbol", "eob", "action")


def _ahead(k: int) -> str:
    w = f"(PARTITION BY symbol ORDER BY eob ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
    return f"round(CASE WHEN count(r) OVER {w} >= {k} THEN product(1 + r) OVER {w} - 1 END, 6) AS forward_{k}"


@query(f"WITH {NATION_MONTH}, p AS (SELECT *, {change()} AS r FROM bars) SELECT symbol, eob, {_ahead(1)}, {_ahead(3)} FROM p")
def forward_compound(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(at.forward_compound(panels.nation_bars(spark, folder), (1, 3)).select("symbol", "eob", "forward_1", "forward_3"))


_loo = " UNION ALL ".join(f"SELECT symbol, eob, rank0, '{f}' AS factor, (mom + gap + vol - {f}) / 2 AS without FROM lk WHERE score IS NOT NULL" for f in FACTORS)


@query(f"{steps(BRAND_WEEK, WEEK, {'score': '(mom + gap + vol) / 3'}, {'rank0': first('score')}, select='0').rsplit(' SELECT 0', 1)[0]}, lk AS (SELECT * FROM s2), lo AS ({_loo}), lr AS (SELECT *, row_number() OVER (PARTITION BY factor, eob ORDER BY without DESC NULLS LAST, symbol) AS rw FROM lo) SELECT symbol, eob, factor, rw - rank0 AS shift, CAST(CASE WHEN rank0 <= 3 AND rw > 3 THEN 1 ELSE 0 END AS BIGINT) AS decisive FROM lr")
def factor_leave_one_out(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(at.factor_leave_one_out(week(spark, folder), FACTORS, 3))


@query(f"{steps(BRAND_WEEK, WEEK, select='0').rsplit(' SELECT 0', 1)[0]}, p AS (SELECT *, {first('mom')} AS p FROM s0 WHERE mom IS NOT NULL AND fwd IS NOT NULL), b AS (SELECT eob, fwd, CASE WHEN p <= 4 THEN 'top' WHEN p <= 8 THEN 'next' ELSE 'rest' END AS bucket FROM p UNION ALL SELECT eob, fwd, 'universe' FROM p) SELECT eob, bucket, round(avg(fwd), 6) AS mean_return, count(*) AS n FROM b GROUP BY ALL")
def ranking_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(at.bucket_attribution(week(spark, folder), "mom", "fwd", 4))


@query(f"{steps(BRAND_WEEK, WEEK, select='0').rsplit(' SELECT 0', 1)[0]}, p AS (SELECT *, {first('mom')} AS p FROM s0 WHERE mom IS NOT NULL AND fwd IS NOT NULL), d AS (SELECT k, eob, avg(fwd) AS x FROM p JOIN (VALUES (2), (4), (8)) t(k) ON p <= k GROUP BY ALL) SELECT CAST(k AS BIGINT) AS k, round(avg(x), 6) AS mean_return, round(stddev_samp(x), 6) AS std_return, count(*) AS days FROM d GROUP BY k")
def topk_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(at.top_sensitivity(week(spark, folder), "mom", "fwd", [2, 4, 8]))


def _coalitions(spark: SparkSession, folder: str) -> DataFrame:
    """A value for every set of 5 event types: the square root of the set's summed values."""
    totals = panels.table(spark, folder, "events").groupBy("event_type").agg(F.sum("value").alias("v"))
    return _masks(spark, totals.withColumn("bit", F.row_number().over(pf.Window.orderBy("event_type")) - 1))


def _masks(spark: SparkSession, totals: DataFrame) -> DataFrame:
    masks = spark.range(32).select(F.col("id").cast("int").alias("mask"))
    return masks.join(F.broadcast(totals), F.expr("(mask & shiftleft(1, bit)) > 0"), "left").groupBy("mask").agg(F.sqrt(F.coalesce(F.sum("v"), F.lit(0.0))).alias("value"))


@query("""WITH t AS (SELECT row_number() OVER (ORDER BY event_type) - 1 AS bit, sum(value) AS v FROM events GROUP BY event_type),
m AS (SELECT mask, sqrt(coalesce(sum(v), 0)) AS value FROM range(32) r(mask) LEFT JOIN t ON (mask & (1 << bit)) > 0 GROUP BY mask),
p AS (SELECT a.value - b.value AS d, player, bit_count(b.mask) AS s FROM m a JOIN range(5) q(player) ON (a.mask & (1 << player)) > 0 JOIN m b ON b.mask = a.mask - (1 << player))
SELECT player, round(sum(d * list_value(24.0, 6.0, 4.0, 6.0, 24.0)[s + 1] / 120), 6) AS shapley FROM p GROUP BY player""")
def shapley_exact(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(at.exact_shapley(_coalitions(spark, folder), 5))


@query(f"{steps(BRAND_WEEK, WEEK, {f'p_{f}': pct_rank(f) for f in FACTORS}, select='0').rsplit(' SELECT 0', 1)[0]}, c AS (SELECT *, (p_mom IS NOT NULL)::INT + (p_gap IS NOT NULL)::INT + (p_vol IS NOT NULL)::INT AS coverage FROM s1) SELECT symbol, eob, round(CASE WHEN coverage >= 2 THEN (coalesce(p_mom, 0) + coalesce(p_gap, 0) + coalesce(p_vol, 0)) / coverage END, 6) AS score, CAST(coverage AS BIGINT) AS coverage FROM c")
def component_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(at.component_snapshot(week(spark, folder), FACTORS, 2).select("symbol", "eob", "score", "coverage"))


@query(f"WITH {BRAND_WEEK}, p AS (SELECT *, {lag('close')} AS p FROM bars), s AS (SELECT symbol, regr_slope(close - p, p) AS slope FROM p GROUP BY symbol) SELECT symbol, round(slope, 6) AS slope, round(CASE WHEN slope < 0 THEN -ln(2) / slope END, 6) AS half_life FROM s")
def half_life(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(at.half_life(panels.brand_bars(spark, folder)))


@query(f"WITH {BRAND_WEEK} SELECT round(regr_slope(ln(a.close), ln(b.close)), 6) AS hedge, round(regr_intercept(ln(a.close), ln(b.close)), 6) AS intercept, round(regr_r2(ln(a.close), ln(b.close)), 6) AS r2, count(*) AS n FROM bars a JOIN bars b USING (eob) WHERE a.symbol = 'Brand#11' AND b.symbol = 'Brand#12'")
def pair_spread(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(at.pair_spread(panels.brand_bars(spark, folder), "Brand#11", "Brand#12"))


@query()
def block_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return at.block_bootstrap(pf.daily_result(held(spark, folder)), "ret", 200, 20, 7)
