"""Overlays: what a trade costs by its time of day, and what trades add to a held position."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252
#: The layers of cost in basis points, and the minutes of the day from which each holds inside the sessions.
COST_BP = {"tight": 16, "base": 21, "wide": 30, "worst": 46, "stress": 66}
LAYERS = ((570, "worst"), (585, "wide"), (870, "base"), (885, "tight"))
SESSIONS = ((570, 690), (780, 900))


def cost_layer(at: Column) -> Column:
    """The layer of a trade at that time; null outside the sessions."""
    minute = F.hour(at) * 60 + F.minute(at)
    layer = F.lit(LAYERS[0][1])
    for start, name in LAYERS[1:]:
        layer = F.when(minute >= start, name).otherwise(layer)
    inside = [minute.between(a, b) for a, b in SESSIONS]
    return F.when(inside[0] | inside[1], layer)


def cost_bp(layer: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in COST_BP.items() for x in pair])[layer]


def trade_bp(sell: Column, buyback: Column, cost: Column) -> tuple[Column, Column]:
    """Gross and net gain in basis points of a sale that is bought back; null unless both prices are positive."""
    gross = F.when((sell > 0) & (buyback > 0), (sell - buyback) / sell * 10_000)
    return gross, gross - cost


def to_daily(rows: DataFrame, at: str, value: str) -> DataFrame:
    """Daily returns of dated values: basis points are added up if any value exceeds 1, else returns are compounded."""
    daily = rows.groupBy(F.to_date(at).alias("eob")).agg(F.sum(value).alias("s_"), (F.product(1 + F.col(value)) - 1).alias("p_"), F.max(F.abs(value)).alias("m_"))
    whole = Window.partitionBy()  # one row a date
    return daily.select("eob", F.when(F.max("m_").over(whole) > 1, F.col("s_") / 10_000).otherwise(F.col("p_")).alias("ret"))


def annualized(ret: Column) -> Column:
    """Compounded return a year of a group of daily returns; nulls count as 0."""
    return F.pow(F.product(1 + F.coalesce(ret, F.lit(0.0))), F.lit(float(YEAR)) / F.count(F.lit(1))) - 1


def overlay_alpha(overlay: DataFrame, base: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What daily overlay returns add a year to those of the held position; days that one side lacks count as 0 there."""
    keys = [*by, "eob"]
    both = overlay.select(*keys, F.col("ret").alias("o_")).join(base.select(*keys, F.col("ret").alias("b_")), keys, "full").fillna(0.0, ["o_", "b_"])
    return both.groupBy(*by).agg((annualized(F.col("o_") + F.col("b_")) - annualized(F.col("b_"))).alias("alpha"))


def overlay_risk(overlay: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Largest drawdown, the longest run of days below a high, Sharpe ratio and return a year of daily overlay returns."""
    order = Window.partitionBy(*by).orderBy("eob")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = overlay.withColumn("r_", F.coalesce("ret", F.lit(0.0))).withColumn("nav_", F.product(1 + F.col("r_")).over(before))
    rows = rows.withColumn("dd_", F.col("nav_") / F.greatest(F.max("nav_").over(before), F.lit(1.0)) - 1)
    rows = rows.withColumn("island_", F.sum((F.col("dd_") >= 0).cast("long")).over(before))
    rows = rows.withColumn("run_", F.sum((F.col("dd_") < 0).cast("long")).over(Window.partitionBy(*by, "island_").orderBy("eob").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by).agg(
        F.abs(F.least(F.min("dd_"), F.lit(0.0))).alias("max_drawdown"), F.max("run_").alias("longest"),
        (F.try_divide(F.avg("r_"), F.stddev_samp("r_")) * math.sqrt(YEAR)).alias("sharpe"), annualized(F.col("r_")).alias("annual"), F.count("*").alias("days"),
    )


def trade_stats(trades: DataFrame, at: str, pnl: str) -> DataFrame:
    """Share of trades that gain, and trades a year over the span of their dates (a day at least)."""
    span = F.greatest(F.date_diff(F.max(at), F.min(at)), F.lit(1))
    return trades.agg(F.avg((F.col(pnl) > 0).cast("double")).alias("win_rate"), (F.count("*") / (span / 365.25)).alias("trades_per_year"))
