"""Queries that write to the stores and read back, with their SQL for DuckDB: what comes out is what went in."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.oracle import BRAND_WEEK
from barloom.functions.windows import change as changed
from barloom.operators import cross_section as cs
from barloom.operators import market as mk
from barloom.operators import portfolio as pf
from barloom.plans import diagnostic_queries, panel_queries
from barloom.plans.panel_queries import FACTORS, _events, held, rounded, week
from barloom.sources import panels, research_store, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return add


def fresh_root(spark: SparkSession) -> str:
    """A new store in the folder that the cluster shares; where the session names none (tests), in the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{where}/stores/{uuid4().hex}"


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly bars under names of digits with leading zeros."""
    return panels.brand_bars(spark, folder).withColumn("symbol", F.lpad(F.split("symbol", "#")[1], 6, "0"))


_NUMBERED = f"{BRAND_WEEK}, d AS (SELECT lpad(split_part(symbol, '#', 2), 6, '0') AS symbol, eob, open, high, low, close, volume FROM bars)"


def _saved(spark: SparkSession, folder: str) -> str:
    root = fresh_root(spark)
    store.save(_numbered(spark, folder), root, "1w")
    return root


@query(f"WITH {_NUMBERED} SELECT symbol, eob, close, volume FROM d")
def stored_bars(spark: SparkSession, folder: str) -> DataFrame:
    return store.read(spark, _saved(spark, folder), "1w").select("symbol", "eob", "close", "volume")


@query(f"WITH {_NUMBERED} SELECT symbol, eob, close FROM d WHERE symbol IN ('000012', '000025')")
def stored_symbol(spark: SparkSession, folder: str) -> DataFrame:
    """Two symbols of the store; the others' partitions are not read."""
    return store.read(spark, _saved(spark, folder), "1w", ["000012", "000025"]).select("symbol", "eob", "close")


@query(f"WITH {_NUMBERED} SELECT DISTINCT symbol FROM d")
def stored_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return store.list_symbols(spark, _saved(spark, folder), "1w")


@query(f"WITH {_NUMBERED} SELECT symbol, round(avg(close), 6) AS mean, count(*) AS n FROM d WHERE eob >= DATE '1996-01-01' GROUP BY symbol")
def stored_market(spark: SparkSession, folder: str) -> DataFrame:
    text = "SELECT symbol, round(avg(close), 6) AS mean, count(*) AS n FROM market WHERE eob >= DATE '1996-01-01' GROUP BY symbol"
    return store.market(spark, _saved(spark, folder), "1w", text)


@query(f"WITH {_NUMBERED} SELECT symbol, CAST(eob AS TIMESTAMP) + INTERVAL 8 HOUR AS eob, round(close, 6) AS close FROM d")
def imported_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Bars written as one CSV in UTC and imported, symbol by symbol, at another zone's wall clock."""
    root = fresh_root(spark)
    rows = _numbered(spark, folder).select("symbol", F.concat(F.col("eob").cast("string"), F.lit(" 00:00:00")).alias("eob"), "open", "high", "low", "close", "volume")
    rows.write.option("header", True).csv(f"{root}/csv")
    store.import_combined(spark, f"{root}/csv", root, "1w")
    return rounded(store.read(spark, root, "1w").select("symbol", "eob", "close"))


def _stored_events(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    root, bars = fresh_root(spark), panels.brand_bars(spark, folder)
    research_store.save_adjustments(_events(bars), root)
    return root, bars


@query(panel_queries.ORACLE_SQL["forward_adjust"])
def stored_adjusted(spark: SparkSession, folder: str) -> DataFrame:
    """Prices adjusted by events that come from the store."""
    root, bars = _stored_events(spark, folder)
    return mk.forward_adjust(bars, store.partitioned(spark, f"{root}/adj_factor", "symbol")).select("symbol", "eob", "close", "volume", "ratio")


@query(panel_queries.ORACLE_SQL["forward_adjust"].rpartition(" SELECT symbol, eob, close")[0] + " SELECT symbol, eob, cum AS cum_factor FROM ev WHERE symbol = 'Brand#12'")
def stored_events(spark: SparkSession, folder: str) -> DataFrame:
    """The adjustment events of one symbol."""
    root, _ = _stored_events(spark, folder)
    return research_store.read_adjustments(spark, root, "Brand#12").select("symbol", "eob", "cum_factor")


@query(panel_queries.ORACLE_SQL["forward_adjust"].rpartition(" SELECT symbol, eob, close")[0] + " SELECT DISTINCT symbol FROM ev")
def stored_event_symbols(spark: SparkSession, folder: str) -> DataFrame:
    root, _ = _stored_events(spark, folder)
    return spark.createDataFrame([(s,) for s in research_store.list_adjustments(spark, root)], "symbol string")


@query(f"WITH {BRAND_WEEK} SELECT symbol, eob, round(close / nullif(lag(close, 5) OVER (PARTITION BY symbol ORDER BY eob), 0) - 1, 6) AS value FROM bars")
def stored_factor(spark: SparkSession, folder: str) -> DataFrame:
    root = fresh_root(spark)
    research_store.save_factor(week(spark, folder).select("symbol", "eob", F.col("mom").alias("value")), root, "007", "mom", {"n": 5})
    return rounded(research_store.read_factor(spark, root, "007", "mom", {"n": 5}))


def _tested(spark: SparkSession, folder: str) -> str:
    """Tests of one factor in two namespaces, one of them run again."""
    root = fresh_root(spark)
    rows = panels.event_day_bars(spark, folder).withColumns({"fac": changed("close", 5), "fwd": cs.forward_return()})
    groups = cs.group_returns(rows, "fac", "fwd", 2).select("eob", F.col("bucket").alias("grp"), (F.col("mean_return") / 100).alias("ret"))
    ic = rounded(cs.rank_ic(rows, "fac", "fwd"))
    research_store.save_factor_test(root, "007", "fac", ic.where("false"), groups, g=2)
    for namespace in ("007", "x"):
        research_store.save_factor_test(root, namespace, "fac", ic, groups, g=2)
    return root


_ROW = diagnostic_queries.ORACLE_SQL["factor_test_row"]


@query(f"SELECT n.namespace, 'fac' AS factor_id, r.* FROM (VALUES ('007'), ('x')) n(namespace), ({_ROW}) r")
def stored_factor_tests(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each namespace's log."""
    return rounded(research_store.factor_tests(spark, _tested(spark, folder)).drop("n", "g", "tested_at"))


@query(panel_queries.ORACLE_SQL["ic_daily"].replace(", count(*) AS n FROM k", " FROM k"))
def stored_ics(spark: SparkSession, folder: str) -> DataFrame:
    return research_store.read_ics(spark, _tested(spark, folder), "x", "fac")


@query(f"SELECT count(*) AS dates FROM ({panel_queries.ORACLE_SQL['ic_daily']})")
def stored_group_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Dates with both groups' returns that have an IC too."""
    root = _tested(spark, folder)
    both = research_store.read_group_returns(spark, root, "x", "fac", g=2).groupBy("eob").count().join(research_store.read_ics(spark, root, "x", "fac"), "eob")
    return both.agg(F.count("*").alias("dates"))


@query("SELECT 'x' AS namespace, 'fac' AS factor_id")
def stored_after_clearing(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of two namespaces when one is cleared."""
    root = _tested(spark, folder)
    research_store.clear_namespace(spark, root, "007")
    return research_store.factor_tests(spark, root).select("namespace", "factor_id")


@query(panel_queries.ORACLE_SQL["factor_correlation"])
def stored_correlation(spark: SparkSession, folder: str) -> DataFrame:
    root = fresh_root(spark)
    research_store.save_correlation(rounded(cs.factor_correlation(week(spark, folder), FACTORS)), root, "007")
    return research_store.read_correlation(spark, root, "007")


def _run(spark: SparkSession, folder: str) -> tuple[str, str]:
    root, rows = fresh_root(spark), held(spark, folder)
    daily = pf.daily_result(rows)
    return root, research_store.save_backtest(root, "007", rounded(daily), rows.select("symbol", "eob", "weight").where("weight > 0"), rounded(pf.metrics(daily)), "momentum", top=5)


@query(panel_queries.ORACLE_SQL["backtest_daily"])
def stored_run(spark: SparkSession, folder: str) -> DataFrame:
    return research_store.read_backtest(spark, *_at(spark, folder))


def _at(spark: SparkSession, folder: str) -> tuple[str, str, str]:
    root, run = _run(spark, folder)
    return root, "007", run


@query(panel_queries.ORACLE_SQL["topn_weights"])
def stored_run_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(research_store.read_backtest_weights(spark, *_at(spark, folder)))


@query(f"SELECT '007' AS namespace, 'momentum' AS description, m.* FROM ({panel_queries.ORACLE_SQL['backtest_metrics']}) m")
def stored_runs(spark: SparkSession, folder: str) -> DataFrame:
    root, _ = _run(spark, folder)
    return research_store.backtests(spark, root, "description = 'momentum'").drop("run_id", "config", "created_at")
