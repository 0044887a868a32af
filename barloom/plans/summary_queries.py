"""Queries over summaries, ledgers, held groups and overfitting, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.oracle import BRAND_WEEK, NATION_MONTH, avg_rank, change
from barloom.operators import attribution as at
from barloom.operators import cross_section as cs
from barloom.operators import research as rs
from barloom.operators import summaries as sm
from barloom.plans import strategy_queries
from barloom.plans.diagnostic_queries import _EDGES, edges
from barloom.plans.panel_queries import FACTORS, WEEK, rounded, week
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


_F = f"{BRAND_WEEK}, f AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in WEEK.items())} FROM bars)"
_D = "d AS (SELECT eob, corr(mom, fwd) AS ic, count(*) AS n FROM f WHERE mom IS NOT NULL AND fwd IS NOT NULL GROUP BY eob HAVING count(*) >= 3)"


def _value_ics(spark: SparkSession, folder: str) -> DataFrame:
    return sm.value_ic(week(spark, folder), "mom", "fwd", 3)


@query(f"WITH {_F}, {_D} SELECT eob, round(ic, 6) AS ic, n FROM d")
def value_ic(spark: SparkSession, folder: str) -> DataFrame:
    """Pearson correlation of momentum and the next return on each date."""
    return rounded(_value_ics(spark, folder))


@query(f"""WITH {_F}, {_D} SELECT round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / stddev_samp(ic), 6) AS ic_ir, round(avg((ic > 0)::INT), 6) AS positive,
round(avg((abs(ic) > 0.02)::INT), 6) AS beyond_2pct, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 6) AS t_stat, count(ic) AS n FROM d""")
def ic_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sm.ic_statistics(_value_ics(spark, folder)))


_SEGMENTS = {"to_1996": "eob < DATE '1997-01-01'", "from_1995": "eob >= DATE '1995-01-01'", "none": "eob < DATE '1900-01-01'"}


@query(f"""WITH {_F}, c AS ({' UNION ALL '.join(f"SELECT '{x}' AS factor, eob, {x} AS x, fwd FROM f" for x in FACTORS)}),
k AS (SELECT factor, eob, {avg_rank('x', 'factor, eob')} AS a, {avg_rank('fwd', 'factor, eob')} AS b FROM c WHERE x IS NOT NULL AND fwd IS NOT NULL), d AS (SELECT factor, eob, corr(a, b) AS ic FROM k GROUP BY ALL HAVING count(*) >= 5),
s AS ({' UNION ALL '.join(f"SELECT '{n}' AS segment, factor, ic FROM d WHERE {c}" for n, c in _SEGMENTS.items())})
SELECT segment, factor, round(avg(ic), 6) AS ic_mean, round(avg(ic) / stddev_samp(ic), 6) AS ic_ir, count(ic) AS n FROM s GROUP BY ALL HAVING count(ic) >= 2""")
def ic_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Rank ICs of three factors in parts of the calendar that overlap."""
    cells = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("x")) for f in FACTORS])
    long = week(spark, folder).select("eob", "fwd", F.explode(cells).alias("c")).select("eob", "fwd", "c.*")
    daily = cs.rank_ic(long, "x", "fwd", 5, ("factor", "eob"))
    return rounded(sm.segmented(daily, {n: F.expr(c) for n, c in _SEGMENTS.items()}, ("factor",)))


_HELD = f"""{_F}, g AS (SELECT symbol, eob, mom AS x, {change()} AS r FROM f), w AS (SELECT * FROM g WHERE x IS NOT NULL AND r IS NOT NULL), t AS (SELECT eob, row_number() OVER (ORDER BY eob) - 1 AS t FROM (SELECT DISTINCT eob FROM bars)),
v AS (SELECT w.*, t, t // 4 AS run FROM w JOIN t USING (eob)), q AS (SELECT symbol, eob, run, greatest(1, coalesce(ceil(p * 3 / nullif(m - 1, 0)), 1)) AS grp FROM (SELECT *, rank() OVER (PARTITION BY eob ORDER BY x) - 1 AS p, count(*) OVER (PARTITION BY eob) AS m FROM v WHERE t % 4 = 0))"""


@query(f"WITH {_HELD} SELECT v.eob, CAST(grp AS BIGINT) AS grp, round(avg(r), 6) AS ret FROM v JOIN q ON q.run = v.run AND q.symbol = v.symbol GROUP BY ALL")
def held_group_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Daily changes of three groups by momentum that are formed every fourth week."""
    return rounded(sm.held_groups(week(spark, folder), "mom", 4, 3)[0])


@query(f"WITH {_HELD}, e AS (SELECT eob, t // 4 AS run FROM t WHERE t % 4 = 0) SELECT e.eob, CAST(a.grp AS BIGINT) AS grp, round(avg((b.grp IS DISTINCT FROM a.grp)::INT), 6) AS turnover FROM q a LEFT JOIN q b ON b.symbol = a.symbol AND b.run = a.run + 1 JOIN e ON e.run = a.run + 1 GROUP BY ALL")
def held_group_turnover(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sm.held_groups(week(spark, folder), "mom", 4, 3)[1])


@query(f"""WITH {BRAND_WEEK}, w AS (SELECT eob, max(volume) FILTER (symbol = 'Brand#12') AS "Brand#12", max(volume) FILTER (symbol = 'Brand#25') AS "Brand#25" FROM bars GROUP BY eob)
SELECT eob, 'x' AS strategy, symbol, weight FROM (UNPIVOT w ON "Brand#12", "Brand#25" INTO NAME symbol VALUE weight)""")
def weight_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A wide table of two brands' volumes as a long ledger."""
    bars = panels.brand_bars(spark, folder)
    wide = bars.groupBy("eob").agg(*[F.max(F.when(F.col("symbol") == s, F.col("volume"))).alias(s) for s in ("Brand#12", "Brand#25")])
    return sm.weight_ledger(wide, "x")


@query(f"""WITH {NATION_MONTH}, r AS (SELECT eob, category, sum(volume) / 20000 AS p, count(*) / 40.0 AS b FROM bars GROUP BY ALL), s AS (SELECT eob, sum(p) AS p, sum(b) AS b, greatest(sum(p), sum(b), 1) AS w FROM r GROUP BY eob),
u AS (SELECT eob, category, p AS portfolio_weight, b AS benchmark_weight FROM r UNION ALL SELECT eob, 'CASH', w - p, w - b FROM s WHERE abs(w - p) > 1e-12 OR abs(w - b) > 1e-12)
SELECT eob, category, round(portfolio_weight, 6) AS portfolio_weight, round(benchmark_weight, 6) AS benchmark_weight, 0.0::DOUBLE AS portfolio_contrib, 0.0::DOUBLE AS benchmark_contrib FROM u""")
def cash_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Category weights of a book and its benchmark, with what is left as cash."""
    rows = panels.nation_bars(spark, folder).groupBy("eob", "category").agg((F.sum("volume") / 20000).alias("portfolio_weight"), (F.count("*") / 40.0).alias("benchmark_weight"))
    return rounded(sm.with_cash(rows.withColumns({"portfolio_contrib": F.lit(0.0), "benchmark_contrib": F.lit(0.0)})))


@query()
def contribution_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What three factors brought to equal weights of the five best of momentum."""
    picks = cs.top_n(week(spark, folder), "mom", 5).select("symbol", "eob", "weight")
    rows = week(spark, folder).join(picks, ["symbol", "eob"], "left")
    return rounded(sm.summarize_contributions(sm.factor_contributions(rows, FACTORS, "fwd", "weight")))


@query(f"""{_EDGES} SELECT player, count(*) AS rows, count(vote_value) AS ok_rows, count(*) - count(vote_value) AS skipped_rows, 0::BIGINT AS topk_entry_edge_count, 0::BIGINT AS exit_prevent_edge_count,
CAST(sum(crit::INT) AS BIGINT) AS entry_critical_count, 0::BIGINT AS exit_critical_count, CAST(sum(coalesce(crit AND held, false)::INT) AS BIGINT) AS hold_critical_count, 0::BIGINT AS topk_edge_count,
CAST(sum(crit::INT) AS BIGINT) AS critical_count, NULL::DOUBLE AS avg_rank_push, 0::BIGINT AS positive_rank_push_count FROM vc GROUP BY player""")
def decision_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of three factors' votes by player."""
    return rounded(sm.decision_edges(edges(spark, folder)))


@query(f"""WITH m AS (SELECT user_id % 7 AS g, event_type AS p, min(event_id) AS s FROM events GROUP BY ALL), f AS (SELECT g, min(s) AS f, string_agg(p, ',' ORDER BY s, p) AS players FROM m GROUP BY g)
SELECT 'g' || g AS "group", row_number() OVER (ORDER BY f) AS place, players FROM f""")
def grouped_players(spark: SparkSession, folder: str) -> DataFrame:
    rows = panels.table(spark, folder, "events").select(F.concat(F.lit("g"), (F.col("user_id") % 7).cast("string")).alias("group"), F.col("event_type").alias("player"), F.col("event_id").alias("seen"))
    return sm.grouped_players(rows).select("group", F.col("place").cast("long").alias("place"), F.array_join("players", ",").alias("players"))


def _overfit_sql(splits: int) -> str:
    """CTEs up to l: combination (bit mask), best, outside_rank, logit."""
    half = splits // 2
    return f"""{_F}, c{splits} AS (SELECT symbol AS candidate, eob, fwd AS ret FROM f WHERE fwd IS NOT NULL), b{splits} AS (SELECT eob, ntile({splits}) OVER (ORDER BY eob) - 1 AS block FROM (SELECT DISTINCT eob FROM c{splits})),
e{splits} AS (SELECT candidate, block, sum(ret) AS s, sum(ret * ret) AS q, count(*) AS n FROM c{splits} JOIN b{splits} USING (eob) GROUP BY ALL), m{splits} AS (SELECT range AS mask FROM range({1 << splits}) WHERE bit_count(range) = {half}),
h{splits} AS (SELECT mask, candidate, (mask >> block) & 1 = 1 AS inside, sum(s) / sum(n) AS m, sum(q) / sum(n) AS q FROM e{splits}, m{splits} GROUP BY ALL),
s{splits} AS (SELECT mask, candidate, max(m / nullif(sqrt(q - m * m), 0)) FILTER (inside) AS i, max(m / nullif(sqrt(q - m * m), 0)) FILTER (NOT inside) AS o FROM h{splits} GROUP BY ALL),
r{splits} AS (SELECT mask, candidate, row_number() OVER (PARTITION BY mask ORDER BY i DESC NULLS LAST, candidate) AS p, rank() OVER (PARTITION BY mask ORDER BY o NULLS FIRST) / (count(*) OVER (PARTITION BY mask) + 1.0) AS k FROM s{splits}),
l{splits} AS (SELECT mask, candidate AS best, k AS outside_rank, ln(k / (1 - k)) AS logit FROM r{splits} WHERE p = 1)"""


ORACLE_SQL["overfitting"] = f"WITH {_overfit_sql(6)}, z AS (SELECT *, list_filter(range(6), lambda b: (mask >> b) & 1 = 1) AS inside FROM l6) SELECT row_number() OVER (ORDER BY inside) - 1 AS combination, best, round(outside_rank, 6) AS outside_rank, round(logit, 6) AS logit FROM z"


def _sensitive(splits: int) -> str:
    return f"""SELECT CAST({splits} AS BIGINT) AS n_splits, count(*) AS n_trials, round(avg((logit <= 0)::INT), 6) AS pbo, round(sqrt(avg((logit <= 0)::INT) * (1 - avg((logit <= 0)::INT)) / count(*)), 6) AS standard_error,
round(1 - avg((logit <= 0)::INT), 6) AS stability, CASE WHEN avg((logit <= 0)::INT) <= 0.2 THEN 'advance' ELSE 'watch' END AS flag, 'ok' AS status FROM l{splits}"""


@query(f"WITH {_overfit_sql(4)}, {_overfit_sql(6)[len(_F) + 2:]} {_sensitive(4)} UNION ALL {_sensitive(6)} UNION ALL SELECT 5, 0, NULL, NULL, NULL, 'watch', 'unavailable'")
def overfitting_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    rows = week(spark, folder).select(F.col("symbol").alias("candidate"), "eob", F.col("fwd").alias("ret")).where("ret IS NOT NULL")
    return rounded(sm.overfitting_sensitivity(rows, (4, 5, 6)))


@query()
def sampled_shapley(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled Shapley values of three factors: a coalition is worth the mean return of the five best of its members' summed ranks."""
    rows = week(spark, folder).dropna(subset=[*FACTORS, "fwd"])
    parts = None
    for mask in range(1 << len(FACTORS)):
        own = {f: 1 for i, f in enumerate(FACTORS) if mask >> i & 1}
        some = cs.top_n(cs.combined_score(rows, own), "score", 5) if own else rows
        part = some.agg(F.lit(mask).alias("mask"), F.avg("fwd").alias("value"))
        parts = part if parts is None else parts.unionByName(part)
    worth = {r["mask"]: r["value"] for r in parts.collect()}  # a number for each coalition
    return rounded(rs.permutation_shapley(spark, len(FACTORS), worth.__getitem__, 200, 1))


@query(f"""SELECT variant AS removed_player, 'unknown' AS ablation_type, 1::BIGINT AS n_variants, delta_return AS return_edge, delta_drawdown AS drawdown_edge, delta_turnover AS turnover_edge, delta_cost AS cost_edge,
-delta_drawdown AS drawdown_relief, -delta_cost AS cost_saving, delta_return AS net_edge FROM ({strategy_queries.ORACLE_SQL['counterfactuals']}) WHERE variant <> 'full'""")
def ablation_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Variants without one of two factors against the book with both."""
    deltas = at.counterfactuals(strategy_queries.variants(spark, folder), "full")
    removed = F.when(F.col("variant") != "full", F.col("variant"))
    return rounded(sm.ablation_edges(deltas.withColumn("removed_player", removed)))
