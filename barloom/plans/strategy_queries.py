"""Queries over strategies, overlays and their summaries, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.oracle import BRAND_WEEK, EVENT_DAY, avg_rank, change, div, lag, lead, over, roll, steps
from barloom.functions.windows import change as changed, ratio, rolling
from barloom.operators import attribution as at
from barloom.operators import cross_section as cs
from barloom.operators import market as mk
from barloom.operators import overlays as ov
from barloom.operators import portfolio as pf
from barloom.operators import strategies as st
from barloom.plans.panel_queries import DAILY, FACTORS, HELD, NATION, PNL, WEEK, _NEUTRAL, _vote, first, held, nation, r, rounded, week
from barloom.sources import panels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
INDEX = "Brand#11"


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def base(text: str) -> str:
    """The CTEs of a `steps` text, without its final select."""
    return text.rsplit(" SELECT 0", 1)[0]


# ---- overlays


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases as trades: sold at the event's value plus 1, bought back at a price that its number decides."""
    rows = panels.table(spark, folder, "events").where("event_type = 'purchase'")
    rows = rows.select("event_id", "ts", (F.col("value") + 1).alias("sell"), (F.col("value") * (0.97 + (F.col("event_id") % 7) * 0.01) + 1).alias("buyback"))
    gross, net = ov.trade_bp(F.col("sell"), F.col("buyback"), F.lit(21.0))
    return rows.withColumns({"gross_bp": gross, "net_bp": net})


TRADES = """tr0 AS (SELECT event_id, ts, value + 1 AS sell, value * (0.97 + (event_id % 7) * 0.01) + 1 AS buyback FROM events WHERE event_type = 'purchase'),
tr AS (SELECT *, CASE WHEN sell > 0 AND buyback > 0 THEN (sell - buyback) / sell * 10000 END AS gross_bp FROM tr0), trades AS (SELECT *, gross_bp - 21.0 AS net_bp FROM tr)"""


@query(f"""WITH {TRADES}, m AS (SELECT *, hour(ts) * 60 + minute(ts) AS mi FROM trades), l AS (SELECT *, CASE WHEN mi < 585 THEN 'worst' WHEN mi < 870 THEN 'wide' WHEN mi < 885 THEN 'base' ELSE 'tight' END AS layer FROM m WHERE mi BETWEEN 570 AND 690 OR mi BETWEEN 780 AND 900)
SELECT event_id, layer, CAST(CASE layer WHEN 'worst' THEN 46 WHEN 'wide' THEN 30 WHEN 'base' THEN 21 ELSE 16 END AS BIGINT) AS cost_bp, round(gross_bp, 6) AS gross_bp FROM l""")
def trade_cost_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Cost layer of each trade inside the sessions, by its time."""
    rows = trades(spark, folder).withColumn("layer", ov.cost_layer(F.col("ts"))).where("layer IS NOT NULL")
    return rounded(rows.select("event_id", "layer", ov.cost_bp(F.col("layer")).alias("cost_bp"), "gross_bp"))


def overlay_days(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Daily returns of the trades, and of a held position: small moves of the daily mean value."""
    own = ov.to_daily(trades(spark, folder), "ts", "net_bp")
    held_days = panels.table(spark, folder, "events").groupBy(F.to_date("ts").alias("eob")).agg(((F.avg("value") - 25) / 1000).alias("move"))
    return own, ov.to_daily(held_days, "eob", "move")


OVERLAY = f"""{TRADES}, od AS (SELECT CAST(ts AS DATE) AS eob, sum(net_bp) / 10000 AS ret FROM trades GROUP BY 1),
bd AS (SELECT CAST(ts AS DATE) AS eob, (avg(value) - 25) / 1000 AS ret FROM events GROUP BY 1),
ob AS (SELECT coalesce(od.eob, bd.eob) AS eob, coalesce(od.ret, 0) AS o, coalesce(bd.ret, 0) AS b FROM od FULL JOIN bd ON od.eob = bd.eob)"""


@query(f"WITH {OVERLAY} SELECT eob, round(o, 6) AS overlay, round(b, 6) AS held FROM ob")
def overlay_daily(spark: SparkSession, folder: str) -> DataFrame:
    own, position = overlay_days(spark, folder)
    both = own.withColumnRenamed("ret", "overlay").join(position.withColumnRenamed("ret", "held"), "eob", "full")
    return rounded(both.fillna(0.0, ["overlay", "held"]))


_RISK = """n0 AS (SELECT *, product(1 + ret) OVER (PARTITION BY k ORDER BY eob ROWS UNBOUNDED PRECEDING) AS nav FROM src),
n1 AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY k ORDER BY eob ROWS UNBOUNDED PRECEDING), 1) - 1 AS dd FROM n0),
n2 AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY eob ROWS UNBOUNDED PRECEDING) AS g FROM n1),
n3 AS (SELECT *, sum(CASE WHEN dd < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k, g ORDER BY eob ROWS UNBOUNDED PRECEDING) AS run FROM n2)"""


@query(f"""WITH {OVERLAY}, src AS (SELECT 1 AS k, * FROM od), {_RISK},
a AS (SELECT pow(product(1 + o + b), 252.0 / count(*)) - pow(product(1 + b), 252.0 / count(*)) AS alpha FROM ob),
k AS (SELECT abs(least(min(dd), 0)) AS max_drawdown, max(run) AS longest, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe FROM n3),
w AS (SELECT avg(CASE WHEN net_bp > 0 THEN 1.0 ELSE 0 END) AS win_rate, count(*) / (greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)), 1) / 365.25) AS trades_per_year FROM trades)
SELECT {r('alpha', 'max_drawdown')}, CAST(longest AS BIGINT) AS longest, {r('sharpe', 'win_rate', 'trades_per_year')} FROM a, k, w""")
def overlay_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Alpha, drawdown, Sharpe ratio, win rate and frequency of the trades."""
    own, position = overlay_days(spark, folder)
    one = F.lit(1).alias("k")  # each side is one row
    parts = [ov.overlay_alpha(own, position), ov.overlay_risk(own), ov.trade_stats(trades(spark, folder), "ts", "net_bp")]
    alpha, risk, stats = (p.select(one, "*") for p in parts)
    return rounded(alpha.join(risk, "k").join(stats, "k").select("alpha", "max_drawdown", "longest", "sharpe", "win_rate", "trades_per_year"))


REGIMES = [("first", 1, 12), ("middle", 8, 22), ("last", 20, 31)]
_slices = " UNION ALL ".join(f"SELECT '{n}' AS k, eob, {{}} FROM {{}} WHERE day(eob) BETWEEN {a} AND {b}" for n, a, b in REGIMES)


@query(f"""WITH {OVERLAY}, src AS ({_slices.replace('{}', 'ret', 1).replace('{}', 'od', 1).replace('{}', 'ret', 1).replace('{}', 'od', 1).replace('{}', 'ret', 1).replace('{}', 'od', 1)}), {_RISK},
both0 AS ({_slices.replace('{}', 'o, b', 1).replace('{}', 'ob', 1).replace('{}', 'o, b', 1).replace('{}', 'ob', 1).replace('{}', 'o, b', 1).replace('{}', 'ob', 1)}),
a AS (SELECT k, pow(product(1 + o + b), 252.0 / count(*)) - pow(product(1 + b), 252.0 / count(*)) AS alpha FROM both0 GROUP BY k),
d AS (SELECT k, abs(least(min(dd), 0)) AS max_drawdown, pow(product(1 + ret), 252.0 / count(*)) - 1 AS annual, count(*) AS days FROM n3 GROUP BY k)
SELECT k AS regime, {r('alpha', 'annual', 'max_drawdown')}, days FROM a JOIN d USING (k)""")
def regime_alpha(spark: SparkSession, folder: str) -> DataFrame:
    """Alpha and drawdown of the trades in date ranges that may overlap."""
    ranges = spark.createDataFrame(REGIMES, "regime string, low int, high int")
    cut = lambda d: d.join(F.broadcast(ranges), F.dayofmonth("eob").between(F.col("low"), F.col("high"))).drop("low", "high")  # noqa: E731  a fixed short list
    own, position = map(cut, overlay_days(spark, folder))
    return rounded(ov.overlay_alpha(own, position, ("regime",)).join(ov.overlay_risk(own, ("regime",)), "regime").select("regime", "alpha", "annual", "max_drawdown", "days"))


# ---- portfolio overlays


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    return panels.brand_bars(spark, folder).where(F.col("symbol") == INDEX).select("eob", "close")


IX = f"ix AS (SELECT eob, close FROM bars WHERE symbol = '{INDEX}'), ixt AS (SELECT eob, CASE WHEN count(close) OVER w >= 20 AND close > avg(close) OVER w THEN 1.0 ELSE 0.0 END AS trend FROM ix WINDOW w AS (ORDER BY eob ROWS 39 PRECEDING))"
BR = f"br0 AS (SELECT *, {roll('avg', 'close', 20, 10)} AS m FROM held), br AS (SELECT eob, coalesce(sum(CASE WHEN close > m THEN 1.0 ELSE 0.0 END) / nullif(count(close), 0), 0.5) AS breadth FROM br0 GROUP BY eob)"


@query(f"WITH {BRAND_WEEK}, {IX} SELECT eob, trend FROM ixt")
def index_trend(spark: SparkSession, folder: str) -> DataFrame:
    return st.index_trend(index_of(spark, folder), 40)


@query(f"WITH {HELD}, {IX} SELECT symbol, h.eob, round(weight * (CASE WHEN trend = 1 THEN 1 WHEN trend = 0 THEN 0.5 ELSE 1 END), 8) AS weight FROM held h LEFT JOIN ixt ON ixt.eob = h.eob")
def index_trend_scaled(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(st.scaled(held(spark, folder).select("symbol", "eob", "weight"), st.trend_scale(index_of(spark, folder), 40)), 8)


@query(f"WITH {HELD}, {BR} SELECT symbol, h.eob, round(weight * (CASE WHEN breadth < 0.45 THEN 0.5 ELSE 1 END), 8) AS weight FROM held h JOIN br USING (eob)")
def breadth_scaled(spark: SparkSession, folder: str) -> DataFrame:
    rows = held(spark, folder)
    return rounded(st.scaled(rows, st.breadth_scale(rows, 0.45)).select("symbol", "eob", "weight"), 8)


@query(f"""WITH {HELD}, {IX}, {BR}, f1 AS (SELECT h.* EXCLUDE (weight), weight * (CASE WHEN breadth < 0.45 THEN 0.5 ELSE 1 END) * (CASE WHEN trend = 0 THEN 0.5 ELSE 1 END) AS weight FROM held h JOIN br USING (eob) LEFT JOIN ixt ON ixt.eob = h.eob),
f2 AS (SELECT *, {lag('weight')} AS w, {change()} AS rr FROM f1), p AS (SELECT eob, sum(w * rr) AS p FROM f2 GROUP BY eob),
v AS (SELECT eob, CASE WHEN count(p) OVER f >= 10 THEN stddev_samp(p) OVER f * sqrt(252) END AS s FROM p WINDOW f AS (ORDER BY eob ROWS 29 PRECEDING))
SELECT symbol, eob, round(weight * coalesce(least(1, 0.01 / nullif(s, 0)), 1), 8) AS weight FROM f1 JOIN v USING (eob)""")
def portfolio_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Breadth, index trend and volatility target, one after another."""
    out = st.portfolio_filters(held(spark, folder), index_of(spark, folder), {"threshold": 0.45}, {"period": 40}, {"target": 0.01, "lookback": 30, "least": 10})
    return rounded(out.select("symbol", "eob", "weight"), 8)


@query(f"""WITH {HELD}, x0 AS (SELECT *, {change()} AS rr FROM held), x1 AS (SELECT *, {roll('stddev_samp', 'rr', 20)} * sqrt(252) AS v FROM x0),
d AS (SELECT eob, avg(v) AS volatility, sum(abs(weight)) AS before FROM x1 GROUP BY eob),
q AS (SELECT *, CASE WHEN count(volatility) OVER f >= 20 THEN quantile_cont(volatility, 0.75) OVER f END AS threshold FROM d WINDOW f AS (ORDER BY eob ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, coalesce(volatility > threshold, false) AS active FROM q)
SELECT eob, active, {r('volatility', 'threshold')}, round(before, 8) AS before, round(before * (CASE WHEN active AND before > 0 THEN least(0.004 / before, 1) ELSE 1 END), 8) AS after FROM z""")
def exposure_control(spark: SparkSession, folder: str) -> DataFrame:
    """Gross weight held down on dates whose universe is more volatile than usual."""
    out = st.exposure_control(held(spark, folder), gross=0.004)
    return out.select("eob", "active", F.round("volatility", 6).alias("volatility"), F.round("threshold", 6).alias("threshold"), F.round("before", 8).alias("before"), F.round("after", 8).alias("after"))


@query(f'WITH {BRAND_WEEK}, x AS (SELECT *, {change()} AS rr FROM bars) SELECT symbol, eob, round(-least(rr, 0), 6) AS "exit" FROM x'.replace("-least(rr, 0)", "CASE WHEN rr IS NOT NULL THEN -least(rr, 0) END"))
def exit_big_loss(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(st.loss_size(panels.brand_bars(spark, folder)).select("symbol", "eob", "exit"))


@query(f'WITH {BRAND_WEEK}, x AS (SELECT *, max(close) OVER {over(20)} AS h FROM bars) SELECT symbol, eob, CASE WHEN coalesce((h - close) / nullif(h, 0), 0) >= 0.08 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS "exit" FROM x')
def exit_soft_drawdown(spark: SparkSession, folder: str) -> DataFrame:
    return st.drawdown_scale(panels.brand_bars(spark, folder)).select("symbol", "eob", "exit")


# ---- the top-share strategy


def voted(spark: SparkSession, folder: str) -> DataFrame:
    return st.vote_weights(cs.votes(week(spark, folder), FACTORS, 0.3))


VOTED = f"{base(steps(BRAND_WEEK, WEEK, {'votes': ' + '.join(map(_vote, FACTORS))}, select='0'))}, voted AS (SELECT *, coalesce(votes / nullif(CAST(sum(votes) OVER (PARTITION BY eob) AS DOUBLE), 0), 0) AS weight FROM s1)"
_FALL = f"coalesce(1 - close / nullif(max(close) OVER {over(20)}, 0), 0)"
KEPT = f"{VOTED}, ex AS (SELECT *, {_FALL} < 0.15 AS keep FROM voted), kept AS (SELECT * EXCLUDE (weight), CASE WHEN keep THEN weight ELSE 0 END AS weight FROM ex)"


@query(f"{VOTED} SELECT symbol, eob, round(weight, 6) AS weight FROM voted")
def top_share_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(voted(spark, folder).select("symbol", "eob", "weight"))


def exited(spark: SparkSession, folder: str) -> DataFrame:
    return pf.drawdown_from_high(voted(spark, folder))


@query(f"{KEPT} SELECT symbol, eob, round(coalesce(weight / nullif(sum(weight) OVER (PARTITION BY eob), 0), 0), 6) AS weight FROM kept")
def top_share_renormalized(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols far under their high go; the others share what they free."""
    return rounded(st.filtered(exited(spark, folder), F.col("exit") < 0.15, "renormalize").select("symbol", "eob", "weight"))


@query(f"{KEPT} SELECT symbol, eob, round(weight + CASE WHEN symbol IN ('Brand#11', 'Brand#12') THEN greatest(1 - sum(weight) OVER (PARTITION BY eob), 0) / count(*) FILTER (symbol IN ('Brand#11', 'Brand#12')) OVER (PARTITION BY eob) ELSE 0 END, 6) AS weight FROM kept")
def top_share_defensive(spark: SparkSession, folder: str) -> DataFrame:
    """What is freed goes to two named symbols."""
    return rounded(st.filtered(exited(spark, folder), F.col("exit") < 0.15, "allocate_defensive", ["Brand#11", "Brand#12"]).select("symbol", "eob", "weight"))


@query(f"""{KEPT}, k2 AS (SELECT *, {change()} AS rr FROM kept), k3 AS (SELECT *, {roll('stddev_samp', 'rr', 20, 10)} AS risk FROM k2),
k4 AS (SELECT *, row_number() OVER (PARTITION BY eob ORDER BY (weight > 0) DESC, risk ASC NULLS LAST, symbol) AS p, greatest(1 - sum(weight) OVER (PARTITION BY eob), 0) AS spare FROM k3)
SELECT symbol, eob, round(weight + CASE WHEN p = 1 AND weight > 0 THEN spare ELSE 0 END, 6) AS weight FROM k4""")
def top_share_calmest(spark: SparkSession, folder: str) -> DataFrame:
    """What is freed goes to the calmest symbol that is held."""
    rows = exited(spark, folder).withColumn("r_", changed()).withColumn("risk", rolling(F.stddev_samp, "r_", 20, 10))
    return rounded(st.filtered(rows, F.col("exit") < 0.15, "allocate_defensive", None, "risk").select("symbol", "eob", "weight"))


@query(f"""{KEPT}, n1 AS (SELECT symbol, eob, close, coalesce(weight / nullif(sum(weight) OVER (PARTITION BY eob), 0), 0) AS weight FROM kept),
d AS (SELECT eob, row_number() OVER (ORDER BY eob) - 1 AS p FROM (SELECT DISTINCT eob FROM n1)),
h AS (SELECT n1.* EXCLUDE (weight), coalesce(last_value(CASE WHEN p % 4 = 0 THEN weight END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY eob ROWS UNBOUNDED PRECEDING), 0) AS weight FROM n1 JOIN d USING (eob)),
g AS (SELECT *, {lag('weight')} AS w, {change()} AS rr FROM h), p AS (SELECT eob, sum(w * rr) AS p FROM g GROUP BY eob),
v AS (SELECT eob, CASE WHEN count(p) OVER f >= 20 THEN stddev_samp(p) OVER f * sqrt(252) END AS s FROM p WINDOW f AS (ORDER BY eob ROWS 59 PRECEDING))
SELECT symbol, eob, round(weight * coalesce(least(1, 2.0 / nullif(s, 0)), 1), 6) AS weight FROM h JOIN v USING (eob)""")
def top_share_strategy(spark: SparkSession, folder: str) -> DataFrame:
    """Votes, exits, renormalising, a rebalance every fourth date and a volatility target."""
    rows = st.filtered(exited(spark, folder), F.col("exit") < 0.15, "renormalize").select("symbol", "eob", "close", "weight")
    rows = mk.hold_every(rows, 4)
    return rounded(st.scaled(rows, pf.volatility_target(rows, 2.0)).select("symbol", "eob", "weight"))


# ---- several strategies


def strategies(spark: SparkSession, folder: str) -> DataFrame:
    """Daily returns of the five best of each factor, held for the next executable bar, at a hundredth of the capital."""
    rows = week(spark, folder).where("fwd IS NOT NULL")
    parts = [cs.top_n(rows, f, 5, 0.01).groupBy("eob").agg(F.sum(F.col("weight") * F.col("fwd")).alias("ret")).select(F.lit(f).alias("strategy"), "eob", "ret") for f in FACTORS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_five = " UNION ALL ".join(f"SELECT '{f}' AS strategy, eob, sum(fwd * 0.01 / n) AS ret FROM (SELECT *, count(*) OVER (PARTITION BY eob) AS n FROM (SELECT *, {first(f)} AS p FROM s0 WHERE fwd IS NOT NULL AND {f} IS NOT NULL) WHERE p <= 5) GROUP BY eob" for f in FACTORS)
STRATEGIES = f"{base(steps(BRAND_WEEK, WEEK, select='0'))}, strategies AS ({_five})"
_MIX = "mix AS (SELECT eob, sum(ret * share) AS combined FROM strategies JOIN shares USING (strategy) GROUP BY eob), cu AS (SELECT *, sum(combined) OVER (ORDER BY eob ROWS UNBOUNDED PRECEDING) AS cumulative FROM mix) SELECT eob, round(combined, 8) AS combined, round(cumulative, 8) AS cumulative, round(cumulative - max(cumulative) OVER (ORDER BY eob ROWS UNBOUNDED PRECEDING), 8) AS drawdown FROM cu"


@query(f"{STRATEGIES}, shares AS (SELECT DISTINCT strategy, 1 / 3.0 AS share FROM strategies), {_MIX}")
def combined_equal(spark: SparkSession, folder: str) -> DataFrame:
    rows = strategies(spark, folder)
    return rounded(st.combined(rows, st.strategy_weights(rows)), 8)


@query(f"{STRATEGIES}, v AS (SELECT strategy, 1 / stddev_samp(ret) AS i FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY eob DESC) AS p FROM strategies) WHERE p <= 60 GROUP BY strategy), shares AS (SELECT strategy, i / sum(i) OVER () AS share FROM v), {_MIX}")
def combined_risk_parity(spark: SparkSession, folder: str) -> DataFrame:
    rows = strategies(spark, folder)
    return rounded(st.combined(rows, st.strategy_weights(rows, "risk_parity")), 8)


@query(f"""{STRATEGIES}, e AS (SELECT *, product(1 + ret) OVER w AS e FROM strategies WINDOW w AS (PARTITION BY strategy ORDER BY eob ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, 1 - e / max(e) OVER (PARTITION BY strategy ORDER BY eob ROWS UNBOUNDED PRECEDING) AS dd FROM e),
m AS (SELECT strategy, arg_max(e, eob) - 1 AS total_return, max(dd) AS max_drawdown, stddev_samp(ret) * sqrt(252) AS v, count(*) AS days FROM f GROUP BY strategy), n AS (SELECT *, pow(1 + total_return, 252.0 / days) - 1 AS ann_return FROM m)
SELECT strategy, {r('total_return', 'ann_return', 'max_drawdown')}, round(ann_return / nullif(v, 0), 6) AS sharpe, round(ann_return / nullif(max_drawdown, 0), 6) AS calmar FROM n""")
def compare_strategies(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(st.compared(strategies(spark, folder)))


@query(f"WITH {DAILY}, ix AS (SELECT eob, close / lag(close) OVER (ORDER BY eob) - 1 AS b FROM bars WHERE symbol = '{INDEX}') SELECT round(corr(ret, b), 6) AS correlation FROM daily JOIN ix USING (eob)")
def benchmark_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(st.benchmark_correlation(pf.daily_result(held(spark, folder)), index_of(spark, folder)))


# ---- weights from scores and predictions


@query(f"{base(steps(BRAND_WEEK, {'s': f'''-({div('close', roll('avg', 'close', 30))} - 1)''', 'rr': change()}, {'p': first('s'), 'sd': roll('stddev_samp', 'rr', 20)}, select='0'))}, i AS (SELECT *, CASE WHEN s IS NOT NULL AND p <= 4 THEN 1 / nullif(sd, 0) END AS i FROM s1), w AS (SELECT symbol, eob, coalesce(i / nullif(sum(i) OVER (PARTITION BY eob), 0), 0) AS weight FROM i), d AS (SELECT eob, row_number() OVER (ORDER BY eob) - 1 AS p FROM (SELECT DISTINCT eob FROM w)) SELECT symbol, eob, round(coalesce(last_value(CASE WHEN p % 3 = 0 THEN weight END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY eob ROWS UNBOUNDED PRECEDING), 0), 6) AS weight FROM w JOIN d USING (eob)")
def gap_reversal_weights(spark: SparkSession, folder: str) -> DataFrame:
    """The four symbols deepest under their mean, by inverse risk, rebalanced every third date."""
    rows = panels.brand_bars(spark, folder).withColumn("score", -(ratio("close", rolling(F.avg, "close", 30)) - 1))
    rows = st.top_weights_by(rows, "score", 4).withColumnRenamed("weight", "picked")
    return rounded(mk.hold_every(pf.inverse_risk(rows, "picked", 20, 20).select("symbol", "eob", "weight"), 3))


@query(f"{base(steps(BRAND_WEEK, {'s': f'''({change('close', 20)} + {change('close', 60)}) / 2'''}, {'p': first('s')}, select='0'))}, w AS (SELECT symbol, eob, CASE WHEN s IS NOT NULL AND p <= 3 THEN 1.0 / count(*) FILTER (s IS NOT NULL AND p <= 3) OVER (PARTITION BY eob) ELSE 0 END AS weight FROM s1) SELECT symbol, eob, round(weight, 6) AS weight FROM w")
def rotation_weights(spark: SparkSession, folder: str) -> DataFrame:
    """The three symbols with the best mean momentum of two spans."""
    rows = panels.brand_bars(spark, folder).withColumn("score", (changed("close", 20) + changed("close", 60)) / 2)
    return rounded(st.top_weights_by(rows, "score", 3).select("symbol", "eob", "weight"))


@query(f"""{base(steps(BRAND_WEEK, WEEK, select='0'))}, last AS (SELECT max(eob) AS eob FROM (SELECT DISTINCT eob FROM bars) GROUP BY date_trunc('month', eob)),
n AS (SELECT *, count(*) OVER (PARTITION BY eob) AS n, min(mom) OVER (PARTITION BY eob) AS lo, max(mom) OVER (PARTITION BY eob) AS hi FROM s0 WHERE mom IS NOT NULL AND eob IN (SELECT eob FROM last)),
q AS (SELECT *, least(floor((row_number() OVER (PARTITION BY eob ORDER BY mom, symbol) - 1) / greatest(floor(n / 5), 1)) + 1, 5) AS b FROM n WHERE n >= 5 AND lo < hi)
SELECT symbol, eob, round(CASE WHEN b = 5 THEN 1.0 / count(*) OVER (PARTITION BY eob, b) WHEN b = 1 THEN -1.0 / count(*) OVER (PARTITION BY eob, b) ELSE 0 END, 6) AS weight FROM q""")
def long_short_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Month ends: the highest fifth long, the lowest short."""
    rows = week(spark, folder)
    return rounded(st.long_short(rows, "mom", 5, mk.last_dates(rows.select("eob").distinct(), "MONTH")).select("symbol", "eob", "weight"))


@query("WITH p AS (SELECT event_id, (user_id % 11) / 10.0 AS high, (event_id % 7) / 6.0 AS low FROM events) SELECT event_id, CASE WHEN high - low > 0.15 THEN 1.0::DOUBLE WHEN high - low < -0.15 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM p")
def probability_spread(spark: SparkSession, folder: str) -> DataFrame:
    rows = panels.table(spark, folder, "events")
    return rows.select("event_id", st.spread_weight((F.col("user_id") % 11) / 10, (F.col("event_id") % 7) / 6, 0.15).alias("weight"))


@query(f"""{base(steps(BRAND_WEEK, WEEK, select='0'))}, p AS (SELECT *, CASE WHEN mom > 0 THEN 1 WHEN mom <= 0 THEN -1 END AS label, gap AS score FROM s0),
q AS (SELECT *, CASE WHEN score >= -0.02 AND score < 0 THEN NULL WHEN score >= 0.3 AND score < 0.5 THEN -coalesce(label, 0) ELSE coalesce(label, 0) END AS pos FROM p)
SELECT symbol, eob, CAST(coalesce(last_value(pos IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY eob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS position FROM q""")
def predicted_positions(spark: SparkSession, folder: str) -> DataFrame:
    rows = week(spark, folder).withColumns({"label": F.when(F.col("mom") > 0, 1).when(F.col("mom") <= 0, -1), "score": F.col("gap")})
    return st.predicted_positions(rows, [(0.3, 0.5)], [(-0.02, 0.0)]).select("symbol", "eob", "position")


# ---- state machines; the SQL walks each symbol's rows one by one


def machine_sql(source: str, last: str, columns: str, state: dict[str, tuple[str, str]], weight: str) -> str:
    """A recursive walk: state name -> (start, next), where p is the row before and n the present one."""
    starts = ", ".join(f"{a} AS {k}" for k, (a, _) in state.items())
    nexts = ", ".join(f"{b} AS {k}" for k, (_, b) in state.items())
    return f"""{source}, rn AS (SELECT symbol, eob, {columns}, row_number() OVER (PARTITION BY symbol ORDER BY eob) AS rn FROM {last}),
wk AS (SELECT symbol, CAST(NULL AS DATE) AS eob, CAST(0 AS BIGINT) AS rn, {starts}, CAST(0 AS DOUBLE) AS weight FROM (SELECT DISTINCT symbol FROM rn)
UNION ALL SELECT *, {weight} AS weight FROM (SELECT n.symbol, n.eob, n.rn, {nexts} FROM wk p JOIN rn n ON n.symbol = p.symbol AND n.rn = p.rn + 1)) SELECT symbol, eob, round(weight, 6) AS weight FROM wk WHERE rn > 0"""


@query(f"WITH {BRAND_WEEK}, x AS (SELECT *, {roll('avg', 'close', 10)} > {roll('avg', 'close', 60)} AS up FROM bars) SELECT symbol, eob, CASE WHEN up THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM x")
def golden_cross(spark: SparkSession, folder: str) -> DataFrame:
    return st.golden_cross(panels.brand_bars(spark, folder)).select("symbol", "eob", "weight")


def _ema(x: str, alpha: float, start: str, out: str) -> str:
    """CTE text of a recursive mean of x over each symbol; the last CTE is {out}_j."""
    from barloom.plans.indicator_queries import ema

    return ema(x, alpha, out, start)[0]


_TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
_REV = f"WITH RECURSIVE {BRAND_WEEK}, t0 AS (SELECT *, {_TR} AS tr, {roll('avg', 'close', 10)} AS mean_ FROM bars), {_ema('tr', 1 / 14, 't0', 'rg')}"
_ready = "n.mean_ IS NOT NULL AND n.rg IS NOT NULL"
_mark = f"CASE WHEN NOT ({_ready}) THEN p.mark WHEN p.held = 0 THEN CASE WHEN n.close < n.mean_ THEN greatest(n.close, n.high) ELSE p.mark END ELSE greatest(p.mark, n.close, n.high) END"
_stop = f"CASE WHEN NOT ({_ready}) THEN p.stop WHEN p.held = 0 THEN CASE WHEN n.close < n.mean_ THEN greatest(n.close, n.high) - 2 * n.rg ELSE p.stop END ELSE greatest(p.stop, greatest(p.mark, n.close, n.high) - 2 * n.rg) END"
_held = f"CASE WHEN NOT ({_ready}) THEN p.held WHEN p.held = 0 THEN CASE WHEN n.close < n.mean_ THEN 1 ELSE 0 END WHEN n.close <= {_stop} THEN 0 ELSE 1 END"
ORACLE_SQL["fsm_reversion_stop"] = machine_sql(_REV, "rg_j", "close, high, mean_, rg", {"mark": ("0.0::DOUBLE", _mark), "stop": ("0.0::DOUBLE", _stop), "held": ("0", _held), "ok": ("0", f"CASE WHEN {_ready} THEN 1 ELSE 0 END")}, "CAST(held * ok AS DOUBLE)")


def _before(fn: str, n: int) -> str:
    w = f"(PARTITION BY symbol ORDER BY eob ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"(CASE WHEN count(close) OVER {w} >= {n} THEN {fn}(close) OVER {w} END)"


_MACH = f"WITH RECURSIVE {BRAND_WEEK}, t0 AS (SELECT *, abs(close - {lag('close')}) AS d, ln(close / {lag('close')}) AS lr FROM bars), {_ema('d', 1 / 14, 't0', 'e')}"
_SHARE = f"(CASE WHEN {roll('stddev_samp', 'lr', 20)} = 0 THEN 1 ELSE least(0.15 / ({roll('stddev_samp', 'lr', 20)} * sqrt(252)), 1) END)"
_WIDTH = "(CASE WHEN count(d) OVER (PARTITION BY symbol ORDER BY eob) >= 14 THEN e END)"
_dready = "n.up IS NOT NULL AND n.lo IS NOT NULL AND n.wd IS NOT NULL AND n.share IS NOT NULL"


def _walk(ready: str, enter: str, leave: str, first: float, trail: float) -> dict[str, tuple[str, str]]:
    mark = f"CASE WHEN NOT ({ready}) THEN p.mark WHEN p.held = 1 THEN greatest(p.mark, n.close) WHEN {enter} THEN n.close ELSE p.mark END"
    stop = f"CASE WHEN NOT ({ready}) THEN p.stop WHEN p.held = 1 THEN greatest(p.stop, greatest(p.mark, n.close) - {trail} * n.wd) WHEN {enter} THEN n.close - {first} * n.wd ELSE p.stop END"
    state = f"CASE WHEN NOT ({ready}) THEN p.held WHEN p.held = 1 THEN CASE WHEN n.close <= {stop} OR {leave} THEN 0 ELSE 1 END WHEN {enter} THEN 1 ELSE 0 END"
    return {"mark": ("0.0::DOUBLE", mark), "stop": ("0.0::DOUBLE", stop), "held": ("0", state), "share": ("0.0::DOUBLE", f"CASE WHEN {ready} THEN n.share ELSE 0 END")}


@query(machine_sql(f"{_MACH}, t1 AS (SELECT *, {_before('max', 20)} AS up, {_before('min', 10)} AS lo, {_WIDTH} AS wd, {_SHARE} AS share FROM e_j)", "t1", "close, up, lo, wd, share", _walk(_dready, "n.close > n.up", "n.close <= n.lo", 2.0, 2.0), "held * share"))
def donchian_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(st.donchian_weights(panels.brand_bars(spark, folder)))


_tready = f"{_dready} AND n.fa IS NOT NULL AND n.sl IS NOT NULL AND n.tm IS NOT NULL"


@query(machine_sql(f"{_MACH}, t1 AS (SELECT *, {_before('max', 20)} AS up, {_before('min', 10)} AS lo, {_WIDTH} AS wd, {_SHARE} AS share, {roll('avg', 'close', 10)} AS fa, {roll('avg', 'close', 20)} AS sl, {roll('avg', 'close', 40)} AS tm FROM e_j), t2 AS (SELECT *, coalesce(tm > {lag('tm', 5)}, false) AS rising FROM t1)", "t2", "close, up, lo, wd, share, fa, sl, tm, rising", _walk(_tready, "n.close > n.tm AND n.rising AND n.close > n.up AND n.fa > n.sl", "n.close <= n.lo OR n.close < n.tm", 2.0, 3.0), "held * share"))
def trend_following_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(st.trend_weights(panels.brand_bars(spark, folder)))


# ---- factors over time


_cc = ", ".join(f"(CASE WHEN isnan(corr(k_{a}, k_{b})) THEN NULL ELSE corr(k_{a}, k_{b}) END) AS c{i}" for i, (a, b) in enumerate((("mom", "gap"), ("mom", "vol"), ("gap", "vol"))))
_cl = " UNION ALL ".join(f"SELECT '{a}' AS factor_a, '{b}' AS factor_b, eob, c{i} AS c FROM dc" for i, (a, b) in enumerate((("mom", "gap"), ("mom", "vol"), ("gap", "vol"))))
_cw = "(PARTITION BY factor_a, factor_b ORDER BY eob ROWS 25 PRECEDING)"


@query(f"{base(steps(BRAND_WEEK, WEEK, {f'k_{f}': avg_rank(f) for f in FACTORS}, select='0'))}, dc AS (SELECT eob, {_cc} FROM s1 GROUP BY eob), cl AS ({_cl}) SELECT factor_a, factor_b, eob, round(CASE WHEN count(c) OVER {_cw} >= 13 THEN avg(c) OVER {_cw} END, 6) AS correlation FROM cl")
def rolling_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(st.rolling_factor_correlation(week(spark, folder), FACTORS, 26, 13))


_ONE = "SELECT eob, corr(a, b) AS {0} FROM (SELECT eob, " + avg_rank("{0}") + " AS a, " + avg_rank("fwd") + " AS b FROM s0 WHERE {0} IS NOT NULL AND fwd IS NOT NULL) GROUP BY eob HAVING count(*) >= 5"
_ICS = f"{base(steps(BRAND_WEEK, WEEK, select='0'))}, di AS (SELECT * FROM ({_ONE.format('mom')}) FULL JOIN ({_ONE.format('gap')}) USING (eob) FULL JOIN ({_ONE.format('vol')}) USING (eob))"
_LATE = "(ORDER BY eob ROWS BETWEEN 27 PRECEDING AND 2 PRECEDING)"


def _capped_sql(source: str) -> str:
    """Weights from x0, x1, x2 of `source` under a cap of one half: at most one of three can be above it."""
    clean = "SELECT eob, " + ", ".join(f"greatest(coalesce(x{i}, 0), 0) AS y{i}" for i in range(3)) + f" FROM {source}"
    own = "SELECT eob, " + ", ".join(f"CASE WHEN y0 + y1 + y2 > 0 THEN y{i} / (y0 + y1 + y2) ELSE 1 / 3.0 END AS w{i}" for i in range(3)) + f" FROM ({clean})"
    top = lambda i: f"CASE WHEN w{i} > 0.5 THEN 0.5 WHEN greatest(w0, w1, w2) <= 0.5 THEN w{i} WHEN 1 - greatest(w0, w1, w2) > 1e-15 THEN 0.5 * w{i} / (1 - greatest(w0, w1, w2)) ELSE 0.25 END"
    return "SELECT eob, " + ", ".join(f"round({top(i)}, 6) AS {f}" for i, f in enumerate(FACTORS)) + f" FROM ({own})"


@query(f"{_ICS}, x AS (SELECT eob, " + ", ".join(f"CASE WHEN count({f}) OVER {_LATE} >= 13 THEN avg({f}) OVER {_LATE} END AS x{i}" for i, f in enumerate(FACTORS)) + f" FROM di) {_capped_sql('x')}")
def factor_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Capped weights of three factors from their ICs of the last 26 weeks, known two weeks late."""
    return rounded(st.factor_weights(_daily_ics(spark, folder), FACTORS, 26, 13, 2, 0.5))


def _daily_ics(spark: SparkSession, folder: str) -> DataFrame:
    rows = week(spark, folder)
    daily = [cs.rank_ic(rows, f, "fwd").select("eob", F.col("ic").alias(f)) for f in FACTORS]
    return daily[0].join(daily[1], "eob", "full").join(daily[2], "eob", "full")


_RATIO = ", ".join(f"CASE WHEN count({f}) OVER {_LATE} >= 13 THEN avg({f}) OVER {_LATE} / nullif(stddev_samp({f}) OVER {_LATE}, 0) END AS m{i}" for i, f in enumerate(FACTORS))
_PAIRS3 = {"p": ("mom", "gap"), "q": ("mom", "vol"), "r": ("gap", "vol")}
_SOLVED = {0: "m0 * (a * a - r * r) + m1 * (q * r - a * p) + m2 * (p * r - a * q)", 1: "m0 * (q * r - a * p) + m1 * (a * a - q * q) + m2 * (p * q - a * r)", 2: "m0 * (p * r - a * q) + m1 * (p * q - a * r) + m2 * (a * a - p * p)"}


@query(f"""{base(steps(BRAND_WEEK, WEEK, {f'k_{f}': avg_rank(f) for f in FACTORS}, select='0'))}, dc AS (SELECT eob, {_cc} FROM s1 GROUP BY eob), cl AS ({_cl}), rc AS (SELECT factor_a, factor_b, eob, CASE WHEN count(c) OVER {_cw} >= 13 THEN avg(c) OVER {_cw} END AS c FROM cl),
wc AS (SELECT eob, {', '.join(f"max(c) FILTER (factor_a = '{a}' AND factor_b = '{b}') AS {k}0" for k, (a, b) in _PAIRS3.items())} FROM rc GROUP BY eob), {_ICS[_ICS.index('di AS'):]},
j AS (SELECT di.eob, {_RATIO}, {', '.join(f"0.5 * lag({k}0, 2) OVER (ORDER BY eob) AS {k}" for k in _PAIRS3)}, 1 + 1e-8 AS a FROM di LEFT JOIN wc USING (eob)),
x AS (SELECT eob, {', '.join(f"({e}) / (a * a * a + 2 * p * q * r - a * (p * p + q * q + r * r)) AS x{i}" for i, e in _SOLVED.items())} FROM j) {_capped_sql('x')}""")
def icir_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Capped weights that maximise the combined IC ratio of three factors, with correlations drawn half way to none."""
    correlations = st.rolling_factor_correlation(week(spark, folder), FACTORS, 26, 13)
    return rounded(st.icir_weights(_daily_ics(spark, folder), correlations, FACTORS, 26, 13, 2, 0.5, 0.5))


@query(f"{base(steps(BRAND_WEEK, {f'l_{f}': f'ln({f})' for f in ('open', 'close')}, select='0'))}, f AS (SELECT symbol, eob, l_open - lag(l_close, 1) OVER w AS logdiff_open_close1_shift0, lag(l_close, 5) OVER w - lag(l_open, 6) OVER w AS logdiff_close_open1_shift5, lag(l_close, 5) OVER w - lag(l_close, 6) OVER w AS full_ FROM s0 WINDOW w AS (PARTITION BY symbol ORDER BY eob)) SELECT symbol, eob, round(logdiff_open_close1_shift0, 6) AS logdiff_open_close1_shift0, round(logdiff_close_open1_shift5, 6) AS logdiff_close_open1_shift5 FROM f WHERE full_ IS NOT NULL")
def log_differences(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.log_differences(panels.brand_bars(spark, folder), ("open", "close"))
    return rounded(rows.select("symbol", "eob", "logdiff_open_close1_shift0", "logdiff_close_open1_shift5"))


@query(f"WITH {BRAND_WEEK}, x AS (SELECT symbol, eob, {change()} AS x FROM bars) SELECT symbol, eob, round(CASE WHEN x > 0 THEN ceil(x * 1000) / 1000 WHEN x < 0 THEN floor(x * 1000) / 1000 WHEN x = 0 THEN 0 END, 6) AS value FROM x")
def rounded_away(spark: SparkSession, folder: str) -> DataFrame:
    rows = panels.brand_bars(spark, folder).withColumn("x", changed())
    return rounded(rows.select("symbol", "eob", st.round_away(F.col("x")).alias("value")))


# ---- summaries of attribution


@query(f"""WITH {NATION}, {_NEUTRAL}, b0 AS (SELECT eob, category, sum(weight) AS wp, sum(benchmark) AS wb, sum(weight * ret) / nullif(sum(weight), 0) AS rp0, sum(benchmark * ret) / nullif(sum(benchmark), 0) AS rb FROM bm GROUP BY ALL),
b1 AS (SELECT *, coalesce(rp0, rb) AS rp, sum(wb * rb) OVER (PARTITION BY eob) AS tot FROM b0), b2 AS (SELECT *, (wp - wb) * (rb - tot) AS al, wb * (rp - rb) AS se, (wp - wb) * (rp - rb) AS it FROM b1)
SELECT category, round(avg(wp), 6) AS avg_portfolio, round(avg(wb), 6) AS avg_benchmark, round(max(wp), 6) AS max_portfolio, round(sum(al), 6) AS allocation, round(sum(se), 6) AS selection, round(sum(it), 6) AS interaction, round(sum(al + se + it), 6) AS total, count(DISTINCT eob) AS days FROM b2 GROUP BY category""")
def brinson_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(at.brinson_summary(at.category_neutral(nation(spark, folder))))


@query(f"""WITH {PNL}, p AS (SELECT eob, sum(gross) AS gross, sum(cost) AS cost, sum(net) AS net FROM pnl GROUP BY eob), d AS (SELECT eob, sum(weight * ret) AS gross FROM nation0 GROUP BY eob)
SELECT p.eob, round(p.gross, 6) AS from_symbols, round(d.gross, 6) AS from_portfolio, abs(coalesce(p.gross, 0) - coalesce(d.gross, 0)) <= 1e-9 AS agrees FROM p JOIN d USING (eob)""")
def daily_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    rows = nation(spark, folder)
    daily = rows.groupBy("eob").agg(F.sum(F.col("weight") * F.col("ret")).alias("from_portfolio"))
    return rounded(at.reconciled(at.symbol_pnl(rows), daily))


_ACT = f"""{NATION}, a0 AS (SELECT *, coalesce({lag('weight')}, 0) AS before FROM nation0), a1 AS (SELECT *, CASE WHEN before <= 1e-9 AND weight > 1e-9 THEN 'buy' WHEN before > 1e-9 AND weight <= 1e-9 THEN 'sell'
WHEN weight - before > 1e-9 THEN 'add' WHEN weight - before < -1e-9 THEN 'reduce' WHEN weight > 1e-9 THEN 'hold' ELSE 'none' END AS action FROM a0)"""


@query(f'WITH {_ACT} SELECT action, count(*) AS actions, round(sum(abs(weight - before)), 6) AS turnover, round(avg(abs(weight - before)), 6) AS mean_turnover, round(avg(ret), 6) AS mean_return, round(sum(weight * ret), 6) AS pnl FROM a1 GROUP BY action')
def action_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(at.action_summary(nation(spark, folder)))


@query(f"""{base(steps(BRAND_WEEK, WEEK, select='0'))}, p AS (SELECT *, {first('mom')} AS p FROM s0 WHERE mom IS NOT NULL AND fwd IS NOT NULL),
d AS (SELECT eob, avg(fwd) FILTER (p <= 4) AS t, avg(fwd) FILTER (p > 4 AND p <= 8) AS n, avg(fwd) FILTER (p > 8) AS x, avg(fwd) AS u FROM p GROUP BY eob)
SELECT count(t) AS dates, round(avg(t), 6) AS top_mean, round(avg(n), 6) AS next_mean, round(avg(x), 6) AS rest_mean, round(avg(u), 6) AS universe_mean, round(avg(t - n), 6) AS over_next, round(avg(t - x), 6) AS over_rest, round(avg(t - u), 6) AS over_universe,
round(avg(CASE WHEN t IS NOT NULL AND n IS NOT NULL THEN (t > n)::INT END), 6) AS wins_next, round(avg(CASE WHEN t IS NOT NULL AND x IS NOT NULL THEN (t > x)::INT END), 6) AS wins_rest, round(avg(CASE WHEN t IS NOT NULL AND u IS NOT NULL THEN (t > u)::INT END), 6) AS wins_universe FROM d""")
def ranking_bucket_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(at.bucket_summary(at.bucket_attribution(week(spark, folder), "mom", "fwd", 4)))


def variants(spark: SparkSession, folder: str) -> DataFrame:
    """The full score and those that lack one factor, each as the daily result of its five best symbols, at a fiftieth of the capital."""
    rows = week(spark, folder).where("mom IS NOT NULL AND gap IS NOT NULL AND vol IS NOT NULL AND fwd IS NOT NULL")
    total = F.col("mom") + F.col("gap")
    parts = []
    for name, score in (("full", total), ("no_mom", F.col("gap")), ("no_gap", F.col("mom"))):
        picks = cs.top_n(rows.withColumn("score", score), "score", 5, 0.02)
        parts.append(picks.groupBy("eob").agg(F.sum(F.col("weight") * F.col("fwd")).alias("gross"), (F.avg("vol") / 1e6).alias("turnover")).select(F.lit(name).alias("variant"), "eob", "gross", "turnover"))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("cost", F.col("turnover") * 0.001).withColumn("ret", F.col("gross") - F.col("cost"))


_vars = " UNION ALL ".join(f"SELECT '{n}' AS variant, eob, sum(fwd * 0.02 / c) AS gross, avg(vol) / 1e6 AS turnover FROM (SELECT *, count(*) OVER (PARTITION BY eob) AS c FROM (SELECT *, row_number() OVER (PARTITION BY eob ORDER BY {x} DESC NULLS LAST, symbol) AS p FROM s0 WHERE mom IS NOT NULL AND gap IS NOT NULL AND vol IS NOT NULL AND fwd IS NOT NULL) WHERE p <= 5) GROUP BY eob" for n, x in (("full", "mom + gap"), ("no_mom", "gap"), ("no_gap", "mom")))
VARIANTS = f"{base(steps(BRAND_WEEK, WEEK, select='0'))}, va0 AS ({_vars}), va AS (SELECT *, turnover * 0.001 AS cost, gross - turnover * 0.001 AS ret FROM va0)"
_vm = """e AS (SELECT *, product(1 + ret) OVER (PARTITION BY variant ORDER BY eob ROWS UNBOUNDED PRECEDING) AS e FROM va), f AS (SELECT *, 1 - e / max(e) OVER (PARTITION BY variant ORDER BY eob ROWS UNBOUNDED PRECEDING) AS dd FROM e),
m AS (SELECT variant, arg_max(e, eob) - 1 AS total_return, max(dd) AS max_drawdown, stddev_samp(ret) * sqrt(252) AS v, count(*) AS days, sum(turnover) AS turnover, sum(cost) AS cost, product(1 + gross) - 1 AS gross FROM f GROUP BY variant),
k AS (SELECT *, pow(1 + total_return, 252.0 / days) - 1 AS ann_return FROM m), b AS (SELECT * FROM k WHERE variant = 'full')"""


@query(f"{VARIANTS}, {_vm} SELECT k.variant, {r('k.ann_return').replace('AS k.', 'AS ')}, round(b.ann_return - k.ann_return, 6) AS delta_return, round(b.max_drawdown - k.max_drawdown, 6) AS delta_drawdown, round(b.ann_return / nullif(b.v, 0) - k.ann_return / nullif(k.v, 0), 6) AS delta_sharpe, round(b.turnover - k.turnover, 6) AS delta_turnover, round(b.cost - k.cost, 6) AS delta_cost FROM k, b")
def counterfactuals(spark: SparkSession, folder: str) -> DataFrame:
    """What the full strategy has over each that lacks a factor."""
    return rounded(at.counterfactuals(variants(spark, folder), "full"))


@query(f"{VARIANTS}, {_vm} SELECT k.variant, round(b.turnover - k.turnover, 6) AS turnover_edge, round(k.cost - b.cost, 6) AS cost_saving, round(k.gross - b.gross, 6) AS opportunity_cost, round(b.total_return - k.total_return, 6) AS net_edge, round(k.cost - b.cost - (k.gross - b.gross), 6) AS net_value FROM k, b WHERE k.variant <> 'full'")
def turnover_costs(spark: SparkSession, folder: str) -> DataFrame:
    """What each factor costs and brings through its trades."""
    return rounded(at.turnover_costs(variants(spark, folder), "full"))


@query(f"""WITH {PNL}, d AS (SELECT eob, sum(net) AS ret FROM pnl WHERE net IS NOT NULL GROUP BY eob), e AS (SELECT *, product(1 + ret) OVER (ORDER BY eob ROWS UNBOUNDED PRECEDING) AS eq FROM d), h AS (SELECT *, 1 - eq / max(eq) OVER (ORDER BY eob ROWS UNBOUNDED PRECEDING) AS dd FROM e),
t AS (SELECT arg_max(eob, (dd, -epoch(eob))) AS trough FROM h), s AS (SELECT max(eob) AS peak FROM h, t WHERE dd = 0 AND eob <= trough)
SELECT symbol, round(sum(net), 6) AS pnl FROM pnl, t, s WHERE eob > peak AND eob <= trough GROUP BY symbol ORDER BY sum(net), symbol LIMIT 5""")
def episode_losers(spark: SparkSession, folder: str) -> DataFrame:
    """The five symbols that lost most in the deepest drawdown."""
    return rounded(at.episode_losers(at.symbol_pnl(nation(spark, folder)), 5))


@query("""WITH t AS (SELECT row_number() OVER (ORDER BY event_type) - 1 AS bit, sum(value) AS v FROM events GROUP BY event_type),
m AS (SELECT mask, sqrt(coalesce(sum(v), 0)) AS value FROM range(32) r(mask) LEFT JOIN t ON (mask & (1 << bit)) > 0 GROUP BY mask)
SELECT a.i AS left_player, b.i AS right_player, round(ab.value - x.value - y.value + e.value, 6) AS interaction FROM range(5) a(i) JOIN range(5) b(i) ON a.i < b.i JOIN m x ON x.mask = (1 << a.i) JOIN m y ON y.mask = (1 << b.i) JOIN m ab ON ab.mask = x.mask + y.mask JOIN m e ON e.mask = 0""")
def pairwise_interactions(spark: SparkSession, folder: str) -> DataFrame:
    from barloom.plans.panel_queries import _coalitions

    return rounded(at.interactions(_coalitions(spark, folder), 5))


@query(f"{base(steps(BRAND_WEEK, {'x': change('close', 4)}, select='0'))}, p AS (SELECT DISTINCT eob FROM bars), o AS (SELECT eob, row_number() OVER (ORDER BY eob) - 1 AS i FROM p), g AS (SELECT *, CAST(floor(i / ceil((SELECT count(*) FROM o) / 6.0)) AS BIGINT) AS fold FROM o), k AS (SELECT fold, min(i) AS a, max(i) AS b FROM g GROUP BY fold) SELECT k.fold, count(*) FILTER (i BETWEEN a AND b) AS test_days, count(*) FILTER (NOT (i BETWEEN a - 4 AND b + 4 + 2)) AS train_days FROM k, o GROUP BY k.fold")
def purged_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Days of test and training for each of six folds, with 4 days purged around a test and 2 more embargoed behind it."""
    return st_folds(panels.brand_bars(spark, folder).select("eob").distinct(), 6, 4, 2)


def st_folds(days: DataFrame, folds: int, purge: int, embargo: int) -> DataFrame:
    from barloom.operators.research import purged_folds as purged

    return rounded(purged(days, folds, purge, embargo))
