"""Bar panels keyed (symbol, eob) built from event and trade tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def to_bars(ticks: DataFrame, symbol: Column, bucket: Column, price: Column, volume: Column, order: list[Column]) -> DataFrame:
    """Open, high, low, close and volume of each symbol and bucket.

    First and last go by `order`, so they are the same on any partitioning. One shuffle on
    (symbol, eob); all five aggregates combine on the map side.
    """
    at = F.struct(*order)
    return ticks.groupBy(symbol.alias("symbol"), bucket.alias("eob")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, at).alias("close"), F.sum(volume).cast("double").alias("volume"),
    )


def event_day_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of event values; symbol is the event type."""
    return to_bars(table(spark, folder, "events"), F.col("event_type"), F.to_date("ts"), F.col("value"), F.lit(1), [F.col("ts"), F.col("event_id")])


def event_minute_bars(spark: SparkSession, folder: str) -> DataFrame:
    """One-minute bars of event values, labelled by the minute they end at."""
    end = F.expr("CAST(date_trunc('MINUTE', ts) AS TIMESTAMP_NTZ) + INTERVAL 1 MINUTE")
    return to_bars(table(spark, folder, "events"), F.col("event_type"), end, F.col("value"), F.lit(1), [F.col("ts"), F.col("event_id")])


def _trades(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    return lines.withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))


_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def brand_bars(spark: SparkSession, folder: str, unit: str = "WEEK") -> DataFrame:
    """Bars of unit prices; symbol is the part's brand."""
    trades = _trades(spark, folder).join(table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return to_bars(trades, F.col("p_brand"), F.date_trunc(unit, "l_shipdate").cast("date"), F.col("price"), F.col("l_quantity"), [F.col(c) for c in _ORDER])


def nation_bars(spark: SparkSession, folder: str, unit: str = "MONTH") -> DataFrame:
    """Bars of unit prices with a category: symbol is the supplier's nation, category its region."""
    places = (
        table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), "n_name", "r_name")
    )
    trades = _trades(spark, folder).join(places, "l_suppkey")
    bars = to_bars(trades, F.col("n_name"), F.date_trunc(unit, "l_shipdate").cast("date"), F.col("price"), F.col("l_quantity"), [F.col(c) for c in _ORDER])
    return bars.join(places.select(F.col("n_name").alias("symbol"), F.col("r_name").alias("category")).distinct(), "symbol")
