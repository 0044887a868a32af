"""Queries over the store's checks: coverage, timeouts, compaction, event chains, set operations, regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources import panels, store


def _days(spark: SparkSession, folder: str) -> DataFrame:
    return panels.table(spark, folder, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), "event_id", "user_id", "value")


def coverage_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Symbol-hours of the grid without an event, unless excused (the first symbol is)."""
    days = _days(spark, folder).withColumn("key", F.concat_ws(" ", F.col("date").cast("string"), F.col("hour").cast("string")))
    hours = days.agg(F.collect_set("key")).scalar()  # one text an hour of the calendar
    grid = days.select("symbol").distinct().select("symbol", F.explode(hours).alias("key"))
    excused = grid.where(F.col("symbol") == "click")
    return store.coverage(grid, days, excused, ["symbol", "key"])


def request_timeouts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _days(spark, folder).select("symbol", "date", F.when(F.col("value") > 20, "failed").otherwise("ok").alias("status"), F.when(F.col("event_id") % 3 == 0, "Request Timed Out").otherwise("refused").alias("error"))
    return store.timeouts(rows, 5)


def compaction(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user and type."""
    rows = store.compacted(_days(spark, folder), ["user_id", "symbol"], "event_id")
    return rows.select("user_id", "symbol", "event_id")


def event_chain(spark: SparkSession, folder: str) -> DataFrame:
    log = panels.table(spark, folder, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("payload"))
    return store.chained(log).select("stream", "seq", "digest", "previous")


def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of customers of one segment."""
    orders, customers = panels.table(spark, folder, "orders"), panels.table(spark, folder, "customer")
    return orders.join(customers.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


def outer_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Target against executed totals of each customer, with both sides' rows kept."""
    orders = panels.table(spark, folder, "orders")
    target = orders.where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("target"))
    done = orders.where("o_orderstatus <> 'O'").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("executed"))
    return target.join(done, "o_custkey", "full").select("o_custkey", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("executed", F.lit(0.0)).alias("executed"))


REGIMES = [("early", "1995-01-01", "1996-12-31"), ("mid", "1996-06-01", "1998-06-30"), ("late", "1998-01-01", "2005-12-31")]


def regime_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Order counts of date ranges that may overlap; the ranges are a fixed short list."""
    ranges = spark.createDataFrame(REGIMES, "regime string, start string, stop string")
    rows = panels.table(spark, folder, "orders").join(F.broadcast(ranges), F.to_date("o_orderdate").between(F.to_date("start"), F.to_date("stop")))
    return rows.groupBy("regime").agg(F.count("*").alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user: events no more than two hours apart."""
    rows = panels.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy("user_id", F.session_window("ts", "2 hours").alias("s")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), "n", "total")


_DAYS = "SELECT event_type AS symbol, CAST(ts AS DATE) AS date, hour(ts) AS hour, event_id, user_id, value FROM events"

QUERIES = {f.__name__: f for f in (coverage_gaps, request_timeouts, compaction, event_chain, semi_join, outer_reconcile, regime_slices, sessions)}
ORACLE_SQL = {
    "coverage_gaps": f"WITH d AS (SELECT *, concat(date, ' ', hour) AS key FROM ({_DAYS})), g AS (SELECT * FROM (SELECT DISTINCT symbol FROM d) CROSS JOIN (SELECT DISTINCT key FROM d)) SELECT symbol, key FROM g WHERE symbol <> 'click' EXCEPT SELECT symbol, key FROM d",
    "request_timeouts": f"SELECT symbol, date, count(*) AS n FROM ({_DAYS}) WHERE value > 20 AND event_id % 3 = 0 GROUP BY ALL HAVING count(*) >= 5",
    "compaction": f"SELECT user_id, symbol, max(event_id) AS event_id FROM ({_DAYS}) GROUP BY ALL",
    "event_chain": "WITH d AS (SELECT event_type AS stream, event_id AS seq, sha256(concat(event_type, '|', event_id, '|', user_id)) AS digest FROM events) SELECT stream, seq, digest, lag(digest) OVER (PARTITION BY stream ORDER BY seq) AS previous FROM d",
    "semi_join": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "outer_reconcile": "WITH t AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS target FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), e AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS executed FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1) SELECT o_custkey, coalesce(target, 0) AS target, coalesce(executed, 0) AS executed FROM t FULL JOIN e USING (o_custkey)",
    "regime_slices": f"SELECT regime, count(*) AS orders, round(avg(o_totalprice), 4) AS mean_price FROM orders JOIN (VALUES {', '.join(str(x) for x in REGIMES)}) r(regime, a, b) ON CAST(o_orderdate AS DATE) BETWEEN CAST(a AS DATE) AND CAST(b AS DATE) GROUP BY regime",
    "sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events), i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, s",
}
