"""Queries over checks of results, unit roots, universe flags and two state machines, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.oracle import BRAND_WEEK, EVENT_DAY, avg_rank, change, lag, lead, over, roll, steps
from barloom.functions.windows import change as changed, kalman_smoothed as smoothed_level
from barloom.operators import cross_section as cs
from barloom.operators import diagnostics as dg
from barloom.operators import strategies as st
from barloom.plans.panel_queries import FACTORS, FWD, WEEK, _vote, rounded, week
from barloom.plans.strategy_queries import KEPT, base, exited, machine_sql
from barloom.sources import panels, research_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# ---- bootstrap tests


def _start(x: str) -> str:
    for _ in range(3):
        x = f"(({x}) * {dg.STEP} + {dg.SHIFT}) % {dg.MODULUS}"
    return f"CAST(floor(({x}) / {float(dg.MODULUS)} * n) AS BIGINT)"


@query(f"""WITH {EVENT_DAY}, r0 AS (SELECT symbol AS candidate, eob, {change()} AS ret FROM bars), r1 AS (SELECT a.candidate, a.eob, a.ret - b.ret AS ret FROM r0 a JOIN r0 b ON b.eob = a.eob AND b.candidate = 'view' WHERE a.candidate <> 'view' AND a.ret IS NOT NULL AND b.ret IS NOT NULL),
fd AS (SELECT eob FROM r1 GROUP BY eob HAVING count(*) = (SELECT count(DISTINCT candidate) FROM r1)), d AS (SELECT r1.*, row_number() OVER (PARTITION BY candidate ORDER BY eob) - 1 AS t FROM r1 SEMI JOIN fd USING (eob)),
pc AS (SELECT candidate, count(*) AS n, avg(ret) AS mean, coalesce(nullif(stddev_samp(ret), 0), (SELECT coalesce(nullif(stddev_samp(ret), 0), 1) FROM d)) AS std FROM d GROUP BY candidate),
pi AS (SELECT *, mean >= -sqrt(greatest(ln(ln(greatest(n, 3))), 1) / n) * std AS inc FROM pc), pj AS (SELECT *, CASE WHEN bool_or(inc) OVER () THEN inc ELSE mean = max(mean) OVER () END AS is_in FROM pi),
hd AS (SELECT first(n) AS n, count(*) AS k, arg_min(candidate, (-mean, candidate)) AS best, max(mean) AS bm, max(CASE WHEN is_in THEN sqrt(n) * mean / std END) AS bs, least(20, first(n)) AS size FROM pj),
ps AS (SELECT i.range AS rep, j.range AS pos, n, size, pos // size AS blk FROM range(200) i CROSS JOIN hd CROSS JOIN range((SELECT n FROM hd)) j),
ix AS (SELECT rep, pos, ({_start('rep * 1000003 + blk * 7919 + 7')} + pos % size) % n AS t FROM ps), mn AS (SELECT rep, candidate, avg(ret - mean) AS m, any_value(std) AS std, any_value(n) AS n, any_value(is_in) AS is_in FROM ix JOIN d USING (t) JOIN pj USING (candidate) GROUP BY rep, candidate),
mx AS (SELECT rep, max(m) AS x, max(CASE WHEN is_in THEN sqrt(n) * m / std END) AS y FROM mn GROUP BY rep), lg AS (SELECT 'reality_check' AS test, bm AS statistic, x FROM mx, hd UNION ALL SELECT 'spa', bs, y FROM mx, hd)
SELECT test, any_value(best) AS best_candidate, round((count(*) FILTER (x >= statistic) + 1) / (count(x) + 1), 6) AS p_value, round(any_value(statistic), 6) AS statistic, round(avg(x), 6) AS bootstrap_mean, round(stddev_samp(x), 6) AS bootstrap_std, any_value(n) AS n_obs, any_value(k) AS n_candidates, any_value(size) AS block_size FROM lg, hd GROUP BY test""")
def superiority_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the best event type's daily change is above that of views, by 200 replicates."""
    bars = panels.event_day_bars(spark, folder)
    rows = bars.select(F.col("symbol").alias("candidate"), "eob", changed().alias("ret"))
    return rounded(dg.superiority_tests(rows, "view", 200, 20, 7))


# ---- votes


_VOTES = f"{base(steps(BRAND_WEEK, WEEK, {f'v_{f}': f'CASE WHEN {f} IS NOT NULL THEN {_vote(f)} END' for f in FACTORS}, select='0'))}, vt AS (SELECT *, coalesce(v_mom, 0) + coalesce(v_gap, 0) + coalesce(v_vol, 0) AS total, (v_mom IS NOT NULL)::INT + (v_gap IS NOT NULL)::INT + (v_vol IS NOT NULL)::INT AS valid FROM s1), vh AS (SELECT *, coalesce({lag('total')} >= 2, false) AS held FROM vt)"
_LONG = " UNION ALL ".join(f"SELECT symbol, eob, 'v_{f}' AS player, CAST(v_{f} AS DOUBLE) AS vote_value, CAST(total AS DOUBLE) AS total, valid, held FROM vh" for f in FACTORS)
_EDGES = f"{_VOTES}, vl AS ({_LONG}), ve AS (SELECT *, total - coalesce(vote_value, 0) AS wo FROM vl), vc AS (SELECT *, total >= 2 AND wo < 2 AS crit FROM ve)"


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Three factors vote for their best 30 % of a date; two votes are enough; held is what was eligible a week before."""
    rows = week(spark, folder)
    for f in FACTORS:
        rows = cs.votes(rows, [f], 0.3).withColumn(f"v_{f}", F.when(F.col(f).isNotNull(), F.col("votes"))).drop("votes")
    names = [f"v_{f}" for f in FACTORS]
    rows = rows.withColumn("total", sum((F.coalesce(v, F.lit(0)) for v in names), F.lit(0)))
    rows = rows.withColumn("before", dg.lag("total") >= 2)
    return dg.vote_criticality(rows, names, 2, held=F.col("before"))


@query(f"""{_EDGES} SELECT symbol, eob, player, vote_value, total AS vote_count_full, CAST(valid AS BIGINT) AS valid_player_count, wo AS vote_count_without_vote, total >= 2 AS eligible_full, wo >= 2 AS eligible_without_vote,
crit AS entry_critical, crit AND held AS hold_critical, round(vote_value / nullif(total, 0), 6) AS score_share, CASE WHEN vote_value IS NULL THEN 'skipped' ELSE 'ok' END AS status FROM vc""")
def vote_criticality(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(edges(spark, folder))


@query(f"""{_EDGES} SELECT player, count(*) AS rows, round(avg((vote_value IS NOT NULL)::INT), 6) AS coverage, CAST(sum(crit::INT) AS BIGINT) AS entry_edges, CAST(sum((crit AND held)::INT) AS BIGINT) AS hold_edges, round(avg(crit::INT), 6) AS entry_edge_rate, round(avg(vote_value / nullif(total, 0)), 6) AS mean_score_share FROM vc GROUP BY player""")
def vote_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(dg.summarize_votes(edges(spark, folder)))


# ---- a factor beside others


_corr = lambda a, b: f"(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END)"


@query(f"""{base(steps(BRAND_WEEK, WEEK, select='0'))}, k0 AS (SELECT * FROM s0 WHERE mom IS NOT NULL AND gap IS NOT NULL AND fwd IS NOT NULL), k AS (SELECT eob, {avg_rank('mom')} AS x, {avg_rank('fwd')} AS y, {avg_rank('gap')} AS z FROM k0),
c AS (SELECT eob, {_corr('x', 'y')} AS ic, {_corr('x', 'z')} AS a, {_corr('y', 'z')} AS b, count(*) AS n FROM k GROUP BY eob HAVING count(*) >= 5), l AS (SELECT *, (1 - a * a) * (1 - b * b) AS l FROM c)
SELECT eob, round(ic, 6) AS ic, round((ic - a * b) / sqrt(CASE WHEN l > 1e-9 THEN l END), 6) AS partial_ic, n FROM l""")
def partial_ic(spark: SparkSession, folder: str) -> DataFrame:
    """What momentum says of the return ahead beyond the gap to the mean."""
    return rounded(cs.partial_rank_ic(week(spark, folder), "mom", "fwd", "gap"))


# ---- exits


def against_exit(spark: SparkSession, folder: str) -> DataFrame:
    """Voted weights, and what of them is left where a symbol fell far below its high."""
    rows = exited(spark, folder).withColumnRenamed("weight", "base")
    return rows.withColumn("variant", F.when(F.col("exit") < 0.15, F.col("base")).otherwise(0.0))


_AB = f"{KEPT}, ab AS (SELECT symbol, eob, close, weight AS base, CASE WHEN keep THEN weight ELSE 0 END AS variant FROM ex)"


@query(f"""{_AB}, dy AS (SELECT eob, sum((base > 0 AND variant = 0)::INT) AS h, sum((base > 0)::INT) AS b, sum(variant) AS e FROM ab GROUP BY eob)
SELECT CAST(sum(h) AS BIGINT) AS hit_count, round(coalesce(sum(h) / nullif(sum(b), 0), 0), 6) AS hit_rate, round(avg(e), 6) AS exposure_mean, round(stddev_samp(e), 6) AS exposure_std, round(avg((e < 0.6)::INT), 6) AS low_exposure_days_pct FROM dy""")
def exit_trigger_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(dg.trigger_stats(against_exit(spark, folder)))


_NEXT = " UNION ALL ".join(f"SELECT CAST({h} AS BIGINT) AS horizon, {' + '.join(f'coalesce(r{k}, 0)' for k in range(1, h + 1))} AS x FROM rl WHERE t" for h in (1, 3, 5, 10))


@query(f"""{_AB}, rr AS (SELECT *, {change()} AS r FROM ab), rl AS (SELECT base > 0 AND variant = 0 AS t, {', '.join(f'{lead("r", k)} AS r{k}' for k in range(1, 11))} FROM rr), ev AS ({_NEXT})
SELECT horizon, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90, round(avg((x < -0.02)::INT), 6) AS big_loss_prob_2pct, round(avg((x < -0.04)::INT), 6) AS big_loss_prob_4pct,
round(avg((x > 0.02)::INT), 6) AS big_gain_prob_2pct, count(*) AS count FROM ev GROUP BY horizon""")
def exit_trigger_returns(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(dg.trigger_returns(against_exit(spark, folder)))


# ---- universe flags, unit roots


_up = f"coalesce(open >= {lag('close')} * 1.1, false)"


@query(f"""WITH {BRAND_WEEK}, fl AS (SELECT symbol, eob, row_number() OVER {over()} <= 26 AS a, coalesce(volume, 0) = 0 AS b, {_up} AS c FROM bars)
SELECT symbol, eob, {', '.join(f'coalesce({lead(x)}, {x}) AS {n}' for x, n in (('a', 'newly_listed'), ('b', 'suspended'), ('c', 'limit_up_open')))} FROM fl""")
def universe_flags(spark: SparkSession, folder: str) -> DataFrame:
    return dg.universe_flags(panels.brand_bars(spark, folder), 26)


def _products(out: str, lags: str, source: str) -> str:
    """CTE text of the products of residuals at distances up to each symbol's `lags`."""
    return f"{out} AS (SELECT a.symbol, b.t - a.t AS k, sum(a.e * b.e) AS g FROM rs a JOIN {source} q ON q.symbol = a.symbol JOIN rs b ON b.symbol = a.symbol AND b.t > a.t AND b.t - a.t <= q.{lags} GROUP BY 1, 2)"


@query(f"""WITH {BRAND_WEEK}, nu AS (SELECT symbol, close AS x, row_number() OVER {over()} AS t FROM bars), co AS (SELECT symbol, count(*) AS n, avg(x) AS mx, avg(t) AS mt, coalesce(covar_pop(x, t) / nullif(var_pop(t), 0), 0) AS b FROM nu GROUP BY symbol),
rs AS (SELECT symbol, t, n, x - mx - b * (t - mt) AS e FROM nu JOIN co USING (symbol)), cu AS (SELECT *, sum(e) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM rs),
pe AS (SELECT symbol, any_value(n) AS n, sum(e * e) AS g0, sum(s * s) AS eta, CAST(floor(any_value(n) ** (2.0 / 9)) AS INT) AS c FROM cu GROUP BY symbol), {_products('p1', 'c', 'pe')},
l1 AS (SELECT pe.symbol, pe.n, g0, eta, g0 + 2 * coalesce(sum(g), 0) AS s0, 2 * coalesce(sum(k * g), 0) AS s1 FROM pe LEFT JOIN p1 USING (symbol) GROUP BY pe.symbol, pe.n, g0, eta), l2 AS (SELECT *, CAST(least(coalesce(floor(1.1447 * ((s1 / nullif(s0, 0)) ** 2) ** (1.0 / 3) * n ** (1.0 / 3)), 0), n - 1) AS INT) AS lags FROM l1), {_products('p2', 'lags', 'l2')},
l3 AS (SELECT l2.symbol, l2.n, l2.lags, eta / nullif(l2.n * (CASE WHEN g0 > 1e-18 THEN g0 + 2 * coalesce(sum(g * (1 - k / (l2.lags + 1.0))), 0) END), 0) AS statistic FROM l2 LEFT JOIN p2 USING (symbol) GROUP BY l2.symbol, l2.n, l2.lags, g0, eta)
SELECT symbol, n AS n_obs, CAST(lags AS BIGINT) AS lags, round(statistic, 6) AS statistic, round(CASE WHEN statistic <= 0.119 THEN 0.1 WHEN statistic <= 0.146 THEN 0.1 - 0.05 * (statistic - 0.119) / 0.027 WHEN statistic <= 0.176 THEN 0.05 - 0.025 * (statistic - 0.146) / 0.03 WHEN statistic <= 0.216 THEN 0.025 - 0.015 * (statistic - 0.176) / 0.04 WHEN statistic IS NOT NULL THEN 0.01 END, 6) AS p_value FROM l3""")
def kpss_test(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(dg.kpss(panels.brand_bars(spark, folder)))


@query()
def adf_test(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(dg.adf(panels.brand_bars(spark, folder)))


@query()
def cointegrated_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Log prices of each brand against those of Brand#11."""
    rows = panels.brand_bars(spark, folder).withColumn("p", F.log("close"))
    index = rows.where("symbol = 'Brand#11'").select("eob", F.col("p").alias("x"))
    return rounded(dg.cointegration(rows.where("symbol <> 'Brand#11'").join(index, "eob").select("symbol", "eob", F.col("p").alias("y"), "x")))


@query(f"""WITH {EVENT_DAY}, x AS (SELECT *, {change('close', 5)} AS fac, {FWD} AS fwd FROM bars), k AS (SELECT eob, symbol, fwd, fac, {avg_rank('fac')} AS a, {avg_rank('fwd')} AS b FROM x WHERE fac IS NOT NULL AND fwd IS NOT NULL),
i AS (SELECT eob, CASE WHEN isnan(corr(a, b)) THEN NULL ELSE round(corr(a, b), 6) END AS ic FROM k GROUP BY eob HAVING count(*) >= 5), rc AS (SELECT ic, CASE WHEN eob > (SELECT max(eob) FROM i) - INTERVAL 12 MONTH THEN ic END AS rec FROM i),
st AS (SELECT avg(ic) AS m, stddev_samp(ic) AS s, avg(rec) AS rm, stddev_samp(rec) AS rsd, avg((ic > 0)::INT) AS pos, avg((abs(ic) > 0.02)::INT) AS big, count(ic) AS n FROM rc),
q AS (SELECT eob, least(floor((row_number() OVER (PARTITION BY eob ORDER BY fac, symbol) - 1) / greatest(floor(count(*) OVER (PARTITION BY eob) / 2), 1)) + 1, 2) AS bucket, fwd FROM k), d AS (SELECT eob, bucket, avg(fwd) / 100 AS r FROM q GROUP BY ALL),
gr AS (SELECT max(r) FILTER (bucket = 2) AS t, max(r) FILTER (bucket = 1) AS b FROM (SELECT bucket, product(1 + coalesce(r, 0)) - 1 AS r FROM d GROUP BY bucket))
SELECT round(m, 6) AS IC_mean, round(s, 6) AS IC_std, round(m / nullif(s, 0), 6) AS IC_IR, round(rm, 6) AS IC_mean_last_1y, round(rm / nullif(rsd, 0), 6) AS IC_IR_LAST_1Y, round(pos, 6) AS IC_positive_ratio, round(big, 6) AS IC_abs_gt_2pct,
round(m / nullif(s, 0) * sqrt(n), 6) AS t_stat, n AS IC_count, round(t, 6) AS top_group_cum_return, round(b, 6) AS bottom_group_cum_return, round(t - b, 6) AS long_short_return FROM st, gr""")
def factor_test_row(spark: SparkSession, folder: str) -> DataFrame:
    """What the store keeps on a test of 5-bar momentum in two groups, at a hundredth of the capital."""
    rows = panels.event_day_bars(spark, folder).withColumns({"fac": changed("close", 5), "fwd": cs.forward_return()})
    groups = cs.group_returns(rows, "fac", "fwd", 2).select("eob", F.col("bucket").alias("grp"), (F.col("mean_return") / 100).alias("ret"))
    return rounded(research_store.test_summary(rounded(cs.rank_ic(rows, "fac", "fwd")), groups))


def _ratio(x: str, parts: tuple[tuple[float, ...], ...]) -> str:
    above, below = (repr(part[0]) for part in parts)
    for c in parts[0][1:]:
        above = f"({above} * {x} + {c!r}::DOUBLE)"
    for c in parts[1][1:]:
        below = f"({below} * {x} + {c!r}::DOUBLE)"
    return f"({above} / {below})"


_quantile = f"(CASE WHEN p < {dg.PPF_LOW} THEN {_ratio('sqrt(-2 * ln(p))', dg.PPF_END)} WHEN p > {1 - dg.PPF_LOW} THEN -{_ratio('sqrt(-2 * ln(1 - p))', dg.PPF_END)} ELSE (p - 0.5) * {_ratio('((p - 0.5) * (p - 0.5))', dg.PPF_MIDDLE)} END)"
_lagged = " UNION ALL ".join(f"SELECT symbol, eob, CAST({k} AS BIGINT) AS lag, y - {lag('y', k)} AS r FROM ly" for k in (1, 2, 5, 13))


@query(f"""WITH {BRAND_WEEK}, ly AS (SELECT symbol, eob, CASE WHEN close > 0 THEN ln(close) END AS y FROM bars), lr AS (SELECT * FROM ({_lagged}) WHERE r IS NOT NULL),
pl AS (SELECT symbol, lag, (r - avg(r) OVER w) / nullif(stddev_samp(r) OVER w, 0) AS z, (row_number() OVER (PARTITION BY symbol, lag ORDER BY r, eob) - 0.5::DOUBLE) / count(*) OVER w AS p FROM lr WINDOW w AS (PARTITION BY symbol, lag)),
mo AS (SELECT symbol, lag, count(*) AS n, avg(z) AS m, stddev_pop(z) AS s, sqrt(avg(pow({_quantile} - z, 2))) AS q FROM pl GROUP BY ALL)
SELECT pl.symbol, pl.lag, n, round(avg(pow((z - m) / s, 4)) - 3, 6) AS kurtosis, round(avg(pow((z - m) / s, 3)), 6) AS skewness, round(q, 6) AS qq_deviation FROM pl JOIN mo USING (symbol, lag) GROUP BY pl.symbol, pl.lag, n, q""")
def return_shapes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(dg.return_shapes(panels.brand_bars(spark, folder), (1, 2, 5, 13)))


@query(f"""WITH RECURSIVE {BRAND_WEEK}, nu AS (SELECT symbol, eob, close, row_number() OVER {over()} AS t, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
fw AS (SELECT symbol, t, n, close AS f, 1.0::DOUBLE AS s FROM nu WHERE t = 1 UNION ALL SELECT b.symbol, b.t, b.n, a.f + (a.s + 0.1::DOUBLE) / (a.s + 1.1::DOUBLE) * (b.close - a.f), (1 - (a.s + 0.1::DOUBLE) / (a.s + 1.1::DOUBLE)) * (a.s + 0.1::DOUBLE) FROM fw a JOIN nu b ON b.symbol = a.symbol AND b.t = a.t + 1),
bw AS (SELECT symbol, t, f AS v FROM fw WHERE t = n UNION ALL SELECT b.symbol, b.t, b.f + b.s / (b.s + 0.1::DOUBLE) * (a.v - b.f) FROM bw a JOIN fw b ON b.symbol = a.symbol AND b.t = a.t - 1) SELECT symbol, eob, round(v, 6) AS smoothed FROM bw JOIN nu USING (symbol, t)""")
def kalman_smoothed(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(smoothed_level(panels.brand_bars(spark, folder)).select("symbol", "eob", "smoothed"))


# ---- state machines


_B = f"WITH RECURSIVE {BRAND_WEEK}, t0 AS (SELECT *, ln(close / {lag('close')}) AS lr, close - {lag('close')} AS d FROM bars)"
_VOL = f"({roll('stddev_samp', 'lr', 20)} * sqrt(252))"


def _recovery(share: str, before: str, cut: str) -> str:
    ready = "n.fa IS NOT NULL AND n.sl IS NOT NULL AND n.tm IS NOT NULL AND n.up IS NOT NULL AND n.share IS NOT NULL"
    lost = "p.held = 1 AND n.close / p.entry - 1 <= -0.08"
    enter = "p.held = 0 AND n.rising AND CASE WHEN p.stopped = 1 THEN n.rn - p.sat >= 5 AND n.close >= p.sprice * 1.03 ELSE n.close > n.up END"
    state = {
        "held": ("0", f"CASE WHEN NOT ({ready}) THEN p.held WHEN p.held = 1 THEN CASE WHEN {lost} OR NOT n.rising THEN 0 ELSE 1 END WHEN {enter} THEN 1 ELSE 0 END"),
        "entry": ("1.0::DOUBLE", f"CASE WHEN {ready} AND {enter} THEN n.close ELSE p.entry END"),
        "cut": ("0", f"CASE WHEN NOT ({ready}) THEN p.cut WHEN {enter} THEN 0 WHEN p.held = 1 AND n.rising THEN {cut} ELSE p.cut END"),
        "stopped": ("0", f"CASE WHEN NOT ({ready}) THEN p.stopped WHEN {lost} THEN 1 WHEN {enter} THEN 0 ELSE p.stopped END"),
        "sprice": ("0.0::DOUBLE", f"CASE WHEN {ready} AND {lost} THEN n.close ELSE p.sprice END"),
        "sat": ("0::BIGINT", f"CASE WHEN {ready} AND {lost} THEN n.rn ELSE p.sat END"),
        "share": ("0.0::DOUBLE", f"CASE WHEN {ready} THEN n.share ELSE 0 END"),
    }
    w = "(PARTITION BY symbol ORDER BY eob ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    up = f"CASE WHEN count(close) OVER {w} >= 20 THEN max(close) OVER {w} END"
    rows = f"{_B}{before}, t1 AS (SELECT *, {roll('avg', 'close', 10)} AS fa, {roll('avg', 'close', 20)} AS sl, {roll('avg', 'close', 40)} AS tm, {up} AS up, {share} AS share FROM {'b1' if before else 't0'}), t2 AS (SELECT *, coalesce(close > tm AND tm > {lag('tm', 5)} AND fa > sl, false) AS rising FROM t1)"
    return machine_sql(rows, "t2", "close, fa, sl, tm, up, share, rising", state, "held * share * CASE WHEN cut = 1 THEN 0.5 ELSE 1 END")


_SHARE = f"(CASE WHEN {_VOL} = 0 THEN 1 ELSE least(2.0 / {_VOL}, 1) END)"
_CUT = "CASE WHEN p.cut = 1 THEN CASE WHEN n.close / p.entry - 1 < -0.02 THEN 1 ELSE 0 END WHEN n.close / p.entry - 1 <= -0.04 THEN 1 ELSE 0 END"
_BAND = f", b0 AS (SELECT *, {_VOL} AS v FROM t0), b2 AS (SELECT *, {lag('v')} AS v0 FROM b0), b1 AS (SELECT *, {roll('quantile_cont({x}, 1.0 / 3)', 'v0', 30)} AS vl, {roll('quantile_cont({x}, 2.0 / 3)', 'v0', 30)} AS vh FROM b2)"
_BANDS = "(CASE WHEN v <= vl THEN 1.0 WHEN v > vl AND v <= vh THEN 0.6 WHEN v > vh THEN 0.3 END)::DOUBLE"
_SHORT = {"target": 2.0, "trend": 40, "breakout": 20, "fast": 10, "slow": 20, "slope": 5}


@query(_recovery(_SHARE, "", "0"))
def vol_recovery_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(st.vol_recovery_weights(panels.brand_bars(spark, folder), **_SHORT))


@query(_recovery(_SHARE, "", _CUT))
def vol_recovery_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(st.vol_recovery_weights(panels.brand_bars(spark, folder), "hybrid", **_SHORT))


@query(_recovery(_BANDS, _BAND, "0"))
def vol_recovery_bands(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(st.vol_recovery_weights(panels.brand_bars(spark, folder), "vol_band", regime=30, **_SHORT))


def _satellite() -> str:
    """The core with its satellite and defence; each step's names stand for its expressions over the row before (p) and the present one (n)."""
    guard = "(p.gd = 1 AND NOT (n.close <= p.gprice * 0.95 OR n.rn - p.gat >= 10))"
    gain = "(n.close / p.oprice - 1)"
    lost = f"(p.os = 1 AND {gain} <= -0.07)"
    kept = f"(p.os = 1 AND NOT ({gain} >= 0.07 OR {gain} <= -0.07 OR n.rn - p.oat >= 10 OR coalesce(n.close >= n.me, false)))"
    wait, sprice, sat = f"(p.wt = 1 OR {lost})", f"(CASE WHEN {lost} THEN n.close ELSE p.sprice END)", f"(CASE WHEN {lost} THEN n.rn ELSE p.sat END)"
    new_guard = f"(NOT {guard} AND n.fc)"
    free = f"(NOT {guard} AND NOT n.fc AND NOT {kept})"
    again = f"({free} AND {wait} AND n.pull AND n.rn - {sat} >= 5 AND n.close >= {sprice} * 1.03)"
    new = f"({again} OR ({free} AND NOT {wait} AND n.oc))"
    bit = lambda x: f"CASE WHEN {x} THEN 1 ELSE 0 END"
    state = {
        "gd": ("0", bit(f"{guard} OR {new_guard}")), "gprice": ("1.0::DOUBLE", f"CASE WHEN {new_guard} THEN n.close ELSE p.gprice END"), "gat": ("0::BIGINT", f"CASE WHEN {new_guard} THEN n.rn ELSE p.gat END"),
        "os": ("0", bit(f"({kept} AND NOT {new_guard}) OR {new}")), "oprice": ("1.0::DOUBLE", f"CASE WHEN {new} THEN n.close ELSE p.oprice END"), "oat": ("0::BIGINT", f"CASE WHEN {new} THEN n.rn ELSE p.oat END"),
        "wt": ("0", bit(f"{wait} AND NOT {again} AND NOT ({free} AND NOT n.pull)")), "sprice": ("1.0::DOUBLE", sprice), "sat": ("0::BIGINT", sat),
    }
    gains = f"t1 AS (SELECT *, {roll('avg', 'greatest(d, CASE WHEN d IS NOT NULL THEN 0 END)', 14)} AS g, {roll('avg', 'greatest(-d, CASE WHEN d IS NOT NULL THEN 0 END)', 14)} AS l, {roll('avg', 'close', 20)} AS me, {roll('avg', 'close', 40)} AS tm, {roll('min', 'close', 20)} AS lw FROM x0)"
    flags = f"t2 AS (SELECT *, coalesce(close < tm AND tm > {lag('tm', 5)}, false) AS pull, coalesce(close / nullif(lw, 0) - 1 >= 0.5, false) AS far, coalesce(100 - 100 / (1 + g / nullif(l, 0)), 50) <= 48 AS weak FROM t1)"
    crossed = f"t3 AS (SELECT *, weak AND pull AS o FROM t2), t4 AS (SELECT *, o AND NOT coalesce({lag('o')}, false) AS oc, far AND NOT coalesce({lag('far')}, false) AS fc FROM t3)"
    return machine_sql(f"{_B}, x0 AS (SELECT * FROM t0), {gains}, {flags}, {crossed}", "t4", "close, me, pull, oc, fc", state, "CAST(CASE WHEN gd = 1 THEN 0 WHEN os = 1 THEN 1.5 ELSE 1 END AS DOUBLE)")


@query(_satellite())
def core_satellite_weights(spark: SparkSession, folder: str) -> DataFrame:
    """With thresholds wide enough for weekly prices by brand."""
    return rounded(st.core_satellite_weights(panels.brand_bars(spark, folder), rsi_below=48, trend=40, slope=5, low=20, distance=0.5))
