"""Queries over loads of tick data, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources import panels, ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return add


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as ticks of fifty symbols."""
    return panels.table(spark, folder, "events").select(
        F.concat(F.lit("U"), (F.col("user_id") % 50).cast("string")).alias("symbol"), F.to_date("ts").alias("date"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), "event_id", "value",
    )


_E = "e AS (SELECT 'U' || (user_id % 50) AS symbol, CAST(ts AS DATE) AS date, ts AS timestamp, event_id, value FROM events), a AS (SELECT DISTINCT symbol, date FROM e)"


@query(f"""WITH {_E}, t AS (SELECT symbol, date FROM a WHERE day(date) > 10 AND symbol <> 'U7'), n AS (SELECT *, (row_number() OVER (PARTITION BY date ORDER BY symbol) - 1) // 8 AS batch FROM t)
SELECT date, batch, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM n GROUP BY date, batch""")
def tick_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Requests for what is not stored (all after the tenth of a month) nor excused (one symbol), eight symbols each."""
    rows = events(spark, folder)
    plan = ticks.plan(rows, rows.where(F.dayofmonth("date") <= 10), rows.where("symbol = 'U7'"))
    return ticks.batches(plan).select("date", F.col("batch").cast("long").alias("batch"), F.array_join("symbols", ",").alias("symbols"))


@query(f"""WITH {_E}, c AS (SELECT *, event_id % 2 AS version FROM e WHERE event_id % 3 = 0), l AS (SELECT symbol, date, max(version) AS version FROM c GROUP BY ALL),
m AS (SELECT symbol, date, timestamp, event_id FROM c SEMI JOIN l USING (symbol, date, version) UNION ALL SELECT symbol, date, timestamp, event_id FROM e ANTI JOIN l USING (symbol, date) WHERE event_id % 3 <> 0)
SELECT strftime(date, '%Y%m') AS month, symbol, count(*) AS rows, count(*) AS last_seq, sum(event_id)::BIGINT AS ids, min(timestamp) AS first FROM m GROUP BY ALL""")
def tick_merge(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the ticks come as chunks in two versions and are laid over the others, symbol-day by symbol-day."""
    rows = events(spark, folder)
    chunks = rows.where("event_id % 3 = 0").withColumn("version", F.col("event_id") % 2)
    return ticks.merged(rows.where("event_id % 3 <> 0"), chunks).groupBy("month", "symbol").agg(F.count("*").alias("rows"), F.max("seq").cast("long").alias("last_seq"), F.sum("event_id").alias("ids"), F.min("timestamp").alias("first"))


_BOOK = "b AS (SELECT symbol, date, timestamp, event_id, CASE WHEN event_id % 97 = 0 THEN 4 ELSE 5 END AS levels FROM e WHERE day(date) <> 3), x AS (SELECT *, lag(timestamp) OVER (PARTITION BY strftime(date, '%Y%m'), symbol ORDER BY event_id) AS p FROM b)"


@query(f"""WITH {_E}, {_BOOK}, n AS (SELECT symbol, date FROM a WHERE day(date) = 3 AND symbol < 'U3'), g AS (SELECT symbol, date FROM a EXCEPT SELECT symbol, date FROM b EXCEPT SELECT symbol, date FROM n),
f AS (SELECT strftime(date, '%Y%m') AS month, 'bad_five_level_bid_price' AS reason, count(*) AS n FROM x WHERE levels = 4 GROUP BY 1 UNION ALL SELECT strftime(date, '%Y%m'), 'timestamp_not_monotonic', count(*) FROM x WHERE timestamp < p GROUP BY 1)
SELECT (SELECT count(*) FROM a) AS expected, (SELECT count(*) FROM (SELECT DISTINCT symbol, date FROM b)) AS observed, (SELECT count(*) FROM b) AS rows, (SELECT count(*) FROM n) AS no_data, 0::BIGINT AS timed_out,
(SELECT count(*) FROM g) AS missing, (SELECT count(*) FROM f) AS faults, 'failed' AS status""")
def tick_report(spark: SparkSession, folder: str) -> DataFrame:
    """A load without the third day of each month, part of it excused, with some books of four levels."""
    rows = events(spark, folder)
    book = rows.where("day(date) <> 3").withColumns({"bid_price": F.array_repeat("value", F.when(F.col("event_id") % 97 == 0, 4).otherwise(5)), "seq": F.col("event_id")})
    none = rows.where("day(date) = 3 AND symbol < 'U3'").select("symbol", "date").distinct()
    return ticks.load_report(rows, book, none, none.where("false"), levels=("bid_price",))


@query(f"""WITH {_E}, s AS (SELECT symbol, min(date) AS a, max(date) + INTERVAL 400 DAY AS b FROM e GROUP BY symbol),
r AS (SELECT symbol, 0 AS part, CAST(a AS DATE) AS f, CAST(b AS DATE) AS b FROM s) SELECT symbol, CAST(k.range AS BIGINT) AS part, CAST(f + to_years(CAST(k.range AS INTEGER)) + to_days(CAST(k.range AS INTEGER)) AS DATE) AS "from",
least(CAST(f + to_years(CAST(k.range + 1 AS INTEGER)) + to_days(CAST(k.range AS INTEGER)) AS DATE), b) AS "to" FROM r JOIN range(3) k ON CAST(f + to_years(CAST(k.range AS INTEGER)) + to_days(CAST(k.range AS INTEGER)) AS DATE) <= b""")
def tick_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Spans from each symbol's first day to 400 days behind its last, in parts of a year."""
    spans = events(spark, folder).groupBy("symbol").agg(F.min("date").alias("a"), F.date_add(F.max("date"), 400).alias("b"))
    return ticks.date_ranges(spans, "a", "b", 1).select("symbol", F.col("part").cast("long").alias("part"), "from", "to")
