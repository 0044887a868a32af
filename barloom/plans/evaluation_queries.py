"""Queries over a candidate beside a pool, robustness, two books, causality and validation, with their SQL for DuckDB."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.oracle import BRAND_WEEK, avg_rank, div, lag, lead
from barloom.functions.windows import lag as lag_of, lead as lead_of, row_no
from barloom.operators import checks as ck
from barloom.operators import cross_section as cs
from barloom.operators import evaluation as ev
from barloom.plans import formula
from barloom.plans.panel_queries import HELD, WEEK, first, held, rounded, week
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


_F = f"f AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in WEEK.items())} FROM bars)"


def _pairs(names: dict[str, str]) -> str:
    """Correlations of all pairs: c_a_b."""
    keys = list(names)
    return ", ".join(f"corr({names[a]}, {names[b]}) AS c_{a}_{b}" for i, a in enumerate(keys) for b in keys[i + 1 :])


def _partial(a: str, b: str, z: str, prefix: str = "c") -> str:
    r = lambda x, y: f"{prefix}_{min(x, y)}_{max(x, y)}"
    return f"(({r(a, b)} - {r(a, z)} * {r(b, z)}) / sqrt((1 - {r(a, z)} * {r(a, z)}) * (1 - {r(b, z)} * {r(b, z)})))"


_RAW = {"1": "gap", "2": "vol", "x": "mom", "y": "fwd"}
_R2 = "((c_1_y * c_1_y + c_2_y * c_2_y - 2 * c_1_y * c_2_y * c_1_2) / (1 - c_1_2 * c_1_2))"


def _beyond(prefix: str) -> str:
    """Correlation of x and y beyond 1 and 2."""
    xy, x2, y2 = (_partial(a, b, "1", prefix) for a, b in (("x", "y"), ("x", "2"), ("y", "2")))
    return f"(({xy} - {x2} * {y2}) / sqrt((1 - {x2} * {x2}) * (1 - {y2} * {y2})))"


@query(f"""WITH {BRAND_WEEK}, {_F}, w AS (SELECT symbol, eob, mom, gap, vol, fwd FROM f WHERE mom IS NOT NULL AND gap IS NOT NULL AND vol IS NOT NULL AND fwd IS NOT NULL),
k AS (SELECT *, count(*) OVER (PARTITION BY eob) AS n, {avg_rank('mom')} AS rx, {avg_rank('gap')} AS r1, {avg_rank('vol')} AS r2, {avg_rank('fwd')} AS ry FROM w),
b AS (SELECT eob, avg(gap) AS m1, avg(vol) AS m2, avg(mom) AS mx, (covar_pop(mom, gap) * var_pop(vol) - covar_pop(mom, vol) * covar_pop(gap, vol)) / (var_pop(gap) * var_pop(vol) - covar_pop(gap, vol) * covar_pop(gap, vol)) AS b1,
(covar_pop(mom, vol) * var_pop(gap) - covar_pop(mom, gap) * covar_pop(gap, vol)) / (var_pop(gap) * var_pop(vol) - covar_pop(gap, vol) * covar_pop(gap, vol)) AS b2 FROM k WHERE n >= 6 GROUP BY eob),
e AS (SELECT eob, ry, mom - mx - b1 * (gap - m1) - b2 * (vol - m2) AS e FROM k JOIN b USING (eob)),
i AS (SELECT eob, corr(re, ry) AS residual_ic FROM (SELECT eob, ry, {avg_rank('e')} AS re FROM e) GROUP BY eob),
c AS (SELECT eob, count(*) AS n, {_pairs(_RAW)}, {_pairs({a: f'r{a}' for a in _RAW}).replace('AS c_', 'AS q_')} FROM k WHERE n >= 6 GROUP BY eob),
d AS (SELECT eob, residual_ic, {_beyond('q')} AS conditional_corr, {_R2} AS r2_before, 1 - (1 - {_R2}) * (1 - {_beyond('c')} * {_beyond('c')}) AS r2_after FROM c JOIN i USING (eob)),
g AS (SELECT eob, {', '.join(f"corr(mom, {m}) AS p_{m}" for m in ('gap', 'vol'))} FROM f WHERE mom IS NOT NULL AND gap IS NOT NULL AND vol IS NOT NULL GROUP BY eob HAVING count(*) >= 6),
h AS (SELECT eob, {', '.join(f"corr(a, {m}r) AS s_{m}" for m in ('gap', 'vol'))} FROM (SELECT eob, {avg_rank('mom')} AS a, {avg_rank('gap')} AS gapr, {avg_rank('vol')} AS volr FROM f WHERE mom IS NOT NULL AND gap IS NOT NULL AND vol IS NOT NULL) GROUP BY eob HAVING count(*) >= 6)
SELECT round((SELECT greatest(abs(avg(p_gap)), abs(avg(p_vol))) FROM g), 6) AS pearson_max_abs, round((SELECT greatest(abs(avg(s_gap)), abs(avg(s_vol))) FROM h), 6) AS spearman_max_abs,
round(avg(residual_ic), 6) AS residual_ic, round(avg(conditional_corr), 6) AS conditional_corr, round(avg(r2_before), 6) AS r2_before, round(avg(r2_after), 6) AS r2_after,
round(avg(r2_after - r2_before), 6) AS r2_delta, count(residual_ic) AS dates, count(r2_before) AS r2_dates FROM d""")
def pool_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """What momentum adds to reversal and volume, on the weeks when all three are known."""
    rows = week(spark, folder).where("mom IS NOT NULL AND gap IS NOT NULL AND vol IS NOT NULL")
    return rounded(ev.compare_to_pool(rows, "mom", ["gap", "vol"], "fwd", least=6))


_PICK = "0.002 / count(*) OVER (PARTITION BY eob) AS weight FROM (SELECT *, {0} AS p FROM f WHERE {1} IS NOT NULL) WHERE p <= 5"


@query(f"""WITH {HELD}, f2 AS (SELECT *, {WEEK['gap']} AS gap FROM bars), o AS (SELECT symbol, eob, {_PICK.format(first('gap'), 'gap').replace('FROM f ', 'FROM f2 ')}),
h2 AS (SELECT h.*, coalesce(o.weight, 0) AS w2 FROM held h LEFT JOIN o USING (symbol, eob)),
w AS (SELECT *, coalesce({lag('weight')}, 0) AS a, coalesce({lag('w2')}, 0) AS b, {div(lead('close'), 'close')} - 1 AS f FROM h2),
t AS (SELECT *, abs(a - coalesce({lag('a')}, 0)) AS ta, abs(b - coalesce({lag('b')}, 0)) AS tb FROM w),
d AS (SELECT eob, sum(a * f) - 0.0004 * sum(ta) AS ra, sum(b * f) - 0.0004 * sum(tb) AS rb, sum(ta) AS ta, sum(tb) AS tb FROM t GROUP BY eob HAVING sum(a * f) IS NOT NULL),
e AS (SELECT *, exp(sum(ln(1 + ra)) OVER (ORDER BY eob)) AS ea, exp(sum(ln(1 + rb)) OVER (ORDER BY eob)) AS eb FROM d),
x AS (SELECT *, 1 - ea / max(ea) OVER (ORDER BY eob) AS da, 1 - eb / max(eb) OVER (ORDER BY eob) AS db FROM e),
s AS (SELECT count(*) AS days, arg_max(ea, eob) - 1 AS ra, arg_max(eb, eob) - 1 AS rb, max(da) AS da, max(db) AS db, avg(ta) AS ta, avg(tb) AS tb FROM x)
SELECT days, {', '.join(f"round({k}a, 6) AS {n}_before, round({k}b, 6) AS {n}_after, round({k}b - {k}a, 6) AS {n}_delta" for n, k in (('return', 'r'), ('drawdown', 'd'), ('turnover', 't')))} FROM s""")
def book_pair(spark: SparkSession, folder: str) -> DataFrame:
    """The five best of momentum against the five best of reversal."""
    base = held(spark, folder)
    other = cs.top_n(week(spark, folder), "gap", 5, 0.002).select("symbol", "eob", F.col("weight").alias("w2"))
    rows = base.join(other, ["symbol", "eob"], "left").withColumn("w2", F.coalesce("w2", F.lit(0.0)))
    return rounded(ev.backtest_pair(rows, "weight", "w2"))


_SLICES = {
    "base": ("mom", "true"), "regime:early": ("mom", "eob < DATE '1995-01-01'"), "regime:rising": ("mom", "close > open"), "liquidity:high": ("mom", "volume >= (SELECT median(volume) FROM w)"),
    "liquidity:low": ("mom", "volume < (SELECT median(volume) FROM w)"), "delay:1": ("late1", "true"), "delay:2": ("late2", "true"),
    "without_extremes": ("mom", "abs(mom) BETWEEN (SELECT quantile_cont(abs(mom), 0.05) FROM w) AND (SELECT quantile_cont(abs(mom), 0.95) FROM w)"),
}


@query(f"""WITH {BRAND_WEEK}, {_F}, g AS (SELECT *, {lag('mom', 1)} AS late1, {lag('mom', 2)} AS late2 FROM f), w AS (SELECT * FROM g WHERE fwd IS NOT NULL),
u AS ({' UNION ALL '.join(f"SELECT '{n}' AS slice, eob, fwd, {x} AS x FROM w WHERE {c}" for n, (x, c) in _SLICES.items())} UNION ALL
SELECT 'out:' || s.symbol, eob, fwd, mom FROM w JOIN (SELECT DISTINCT symbol FROM w) s ON s.symbol <> w.symbol),
k AS (SELECT slice, eob, {avg_rank('x', 'slice, eob')} AS a, {avg_rank('fwd', 'slice, eob')} AS b FROM u WHERE x IS NOT NULL),
d AS (SELECT slice, eob, corr(a, b) AS ic FROM k GROUP BY slice, eob HAVING count(*) >= 5 AND NOT isnan(corr(a, b)) AND corr(a, b) IS NOT NULL),
h AS (SELECT *, row_number() OVER o AS p, count(*) OVER (PARTITION BY slice) AS n, avg(ic) OVER (PARTITION BY slice ORDER BY eob ROWS 4 PRECEDING) AS rolled FROM d WINDOW o AS (PARTITION BY slice ORDER BY eob)),
v AS (SELECT slice, ic FROM d UNION ALL SELECT CASE WHEN p <= n // 2 THEN 'first_half' ELSE 'second_half' END, ic FROM h WHERE slice = 'base' UNION ALL SELECT 'rolling', rolled FROM h WHERE slice = 'base' AND p >= 5),
m AS (SELECT slice, CASE WHEN count(ic) >= 2 THEN avg(ic) END AS ic_mean, stddev_samp(ic) AS ic_std, count(ic) AS dates FROM v GROUP BY slice)
SELECT slice, round(ic_mean, 6) AS ic_mean, round(ic_std, 6) AS ic_std, dates FROM m WHERE slice NOT LIKE 'out:%'
UNION ALL SELECT 'leave_out', round(avg(ic_mean), 6), round(stddev_samp(ic_mean), 6), count(ic_mean) FROM m WHERE slice LIKE 'out:%'""")
def robustness_report(spark: SparkSession, folder: str) -> DataFrame:
    """Momentum over all brands and in parts of the sample."""
    regimes = {"early": F.col("eob") < F.lit("1995-01-01").cast("date"), "rising": F.col("close") > F.col("open")}
    return rounded(ev.robustness(week(spark, folder), "mom", "fwd", regimes, {"liquidity": "volume"}, leave_out="symbol"))


# ---- causality and validation


_AHEAD = {"op": "-", "args": [{"call": "mean", "args": [{"field": "close"}], "n": 5}, {"call": "lag", "args": [{"field": "close"}], "n": 1}]}
_CUTS = ("1994-06-06", "1996-01-01", "1997-12-29")


def _prefix_sql(name: str, value: str) -> str:
    cut = f"SELECT '{name}' AS formula, c.cut, b.symbol, b.eob, {value.format(w='PARTITION BY c.cut, b.symbol ORDER BY b.eob')} AS v FROM bars b JOIN c ON b.eob <= c.cut"
    return f"SELECT formula, cut, count(*) AS rows, count(*) FILTER (p.v IS DISTINCT FROM a.v) AS changed FROM ({cut}) p JOIN (SELECT symbol, eob, {value.format(w='PARTITION BY symbol ORDER BY eob')} AS v FROM bars b) a USING (symbol, eob) GROUP BY ALL"


@query(f"""WITH {BRAND_WEEK}, c AS (SELECT unnest([{', '.join(f"DATE '{c}'" for c in _CUTS)}]) AS cut), x AS ({_prefix_sql('behind', 'lag(b.close, 3) OVER ({w})')} UNION ALL {_prefix_sql('ahead', 'lead(b.close, 2) OVER ({w})')})
SELECT formula, cut, rows, changed, changed = 0 AS passed FROM x""")
def prefix_causality(spark: SparkSession, folder: str) -> DataFrame:
    """A close of three weeks before passes at every cut, one of two weeks ahead does not."""
    bars = panels.brand_bars(spark, folder)
    out = None
    for name, value in (("behind", lag_of("close", 3)), ("ahead", lead_of("close", 2))):
        rows = ck.prefix_causality(bars, lambda df, value=value: df.withColumn("value", value), cuts=[datetime.date.fromisoformat(c) for c in _CUTS])
        rows = rows.select(F.lit(name).alias("formula"), "cut", "rows", "changed", "passed")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {BRAND_WEEK}, c AS (SELECT unnest([{', '.join(f"DATE '{c}'" for c in _CUTS)}]) AS cut) SELECT cut, count(*) AS rows, CAST(0 AS BIGINT) AS changed, true AS passed FROM bars JOIN c ON eob <= cut GROUP BY cut""")
def formula_causality(spark: SparkSession, folder: str) -> DataFrame:
    """A compiled formula with a rank over each date, at three cuts: no row to come changes it."""
    tree = {"op": "-", "args": [{"call": "rank", "args": [_AHEAD]}, {"const": 0.5}]}
    rows = ck.prefix_causality(panels.brand_bars(spark, folder), lambda df: formula.evaluate(df, tree), cuts=[datetime.date.fromisoformat(c) for c in _CUTS])
    return rows.select("cut", "rows", "changed", "passed")


_DIRTY = """d AS (SELECT CASE WHEN l_linenumber = 7 THEN ' ' ELSE l_returnflag || l_linestatus END AS symbol, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS close, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS volume,
l_extendedprice - l_quantity AS high, l_extendedprice AS low, l_extendedprice AS open FROM lineitem), k AS (SELECT symbol, day, count(*) AS n FROM d GROUP BY ALL)"""


@query(f"""WITH {_DIRTY}, f AS (SELECT 'symbol_names' AS code, (SELECT count(*) FROM d WHERE trim(symbol) = '') AS n, 'hard_fail' AS s UNION ALL SELECT 'times', 0, 'hard_fail' UNION ALL SELECT 'unique_keys', (SELECT sum(n - 1) FROM k), 'hard_fail'
UNION ALL SELECT 'symbol_times', (SELECT count(DISTINCT symbol) FROM k WHERE n > 1), 'hard_fail' UNION ALL SELECT 'bars', (SELECT sum((high < low)::INT + (high < greatest(open, close))::INT + (low > least(open, close))::INT) FROM d), 'soft_fail'
UNION ALL SELECT 'infinite:close', 0, 'soft_fail' UNION ALL SELECT 'infinite:volume', 0, 'soft_fail' UNION ALL SELECT 'universe', (SELECT count(DISTINCT symbol) FROM d WHERE symbol NOT IN ('AF', 'NO')), 'hard_fail')
SELECT code, n = 0 AS passed, CASE WHEN n = 0 THEN 'info' ELSE s END AS severity, CAST(CAST(n AS BIGINT) AS VARCHAR) AS detail FROM f
UNION ALL SELECT 'coverage:' || c, true, 'info', v FROM (SELECT 'close' AS c, '1.0' AS v UNION ALL SELECT 'volume', CAST(CAST(round(avg((volume IS NOT NULL)::INT), 6) AS DOUBLE) AS VARCHAR) FROM d)
UNION ALL SELECT 'coverage', avg((volume IS NOT NULL)::INT) >= 0.95, CASE WHEN avg((volume IS NOT NULL)::INT) >= 0.95 THEN 'info' ELSE 'soft_fail' END, CAST(CAST(round(avg((volume IS NOT NULL)::INT), 6) AS DOUBLE) AS VARCHAR) FROM d
UNION ALL SELECT * FROM (VALUES ('levels', true, 'info', 'symbol, day'), ('symbol_type', true, 'info', 'string'), ('required_fields', false, 'hard_fail', 'amount'), ('panel', false, 'info', ''))""")
def panel_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of a panel that breaks several: trades by flag and day, with nameless rows, missing volumes and repeated keys."""
    rows = panels.table(spark, folder, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, " ").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("symbol"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("close"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("volume"), (F.col("l_extendedprice") - F.col("l_quantity")).alias("high"), F.col("l_extendedprice").alias("low"), F.col("l_extendedprice").alias("open"),
    )
    return ck.validate_panel(rows, ("close", "volume", "amount"), universe=("AF", "NO"), least_coverage=0.95)


@query(f"""WITH {BRAND_WEEK}, v AS (SELECT symbol, eob, {lag('close', 4)} AS value, row_number() OVER (PARTITION BY symbol ORDER BY eob) AS p FROM bars), w AS (SELECT * FROM v WHERE p <> 30),
r AS (SELECT 'duplicate_keys' AS code, 0 AS n, 'hard_fail' AS s UNION ALL SELECT 'keys', (SELECT count(*) FROM v WHERE p = 30), 'hard_fail' UNION ALL SELECT 'infinite', 0, 'hard_fail' UNION ALL SELECT 'warmup', 1, 'hard_fail' UNION ALL SELECT 'holes', (SELECT count(*) FROM v WHERE p = 30), 'soft_fail')
SELECT code, n = 0 AS passed, CASE WHEN n = 0 THEN 'info' ELSE s END AS severity, CAST(n AS VARCHAR) AS detail FROM r""")
def output_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Values with four rows of warm-up where three are declared, without each symbol's thirtieth row."""
    bars = panels.brand_bars(spark, folder)
    values = bars.withColumns({"value": lag_of("close", 4), "p": row_no()}).where("p <> 30")
    return ck.alignment(bars, values, warmup=3)


@query()
def table_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Content digests of the weekly bars of every brand."""
    return ck.content_hash(panels.brand_bars(spark, folder), ("symbol",))
