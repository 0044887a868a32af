"""Bars and calendars: quality checks, as-of adjustment, resampling, rebalance dates, holding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import prefix, ratio, series


def validate(bars: DataFrame) -> DataFrame:
    """Counts of faults in each symbol's bars: missing, negative, crossed and repeated."""
    bad = lambda cond: F.sum(F.coalesce(cond.cast("long"), F.lit(0)))
    missing = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    rows = bars.withColumn("again_", F.lag("eob").over(series()) == F.col("eob"))
    return rows.groupBy("symbol").agg(
        F.count("*").alias("rows"), bad(missing).alias("missing"), bad((F.col("open") <= 0) | (F.col("low") <= 0)).alias("not_positive"),
        bad(F.col("volume") < 0).alias("negative_volume"), bad((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))).alias("crossed"),
        bad(F.col("again_")).alias("repeated"),
    )


def zero_volume_jumps(bars: DataFrame, threshold: float, least_volume: float = 0.0) -> DataFrame:
    """Bars without trade whose close lies more than `threshold` off the last traded close."""
    idle = F.col("volume") <= least_volume
    last = F.last(F.when(~idle, F.col("close")), ignorenulls=True).over(prefix())
    rows = bars.withColumns({"traded_close": last, "idle_": idle}).withColumn("jump", ratio("close", "traded_close") - 1)
    return rows.where(F.col("idle_") & (F.abs("jump") > threshold)).select("symbol", "eob", "close", "traded_close", "jump")


def repair_idle(bars: DataFrame, least_volume: float = 0.0) -> DataFrame:
    """Prices of bars without trade replaced by the last traded close."""
    idle = F.col("volume") <= least_volume
    last = F.last(F.when(~idle, F.col("close")), ignorenulls=True).over(prefix())
    rows = bars.withColumns({"last_": last, "idle_": idle})
    return rows.withColumns({c: F.when(F.col("idle_"), F.coalesce("last_", c)).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}).drop("last_", "idle_")


def as_of(left: DataFrame, right: DataFrame, value: str, at: str = "eob", by: str = "symbol", out: str = "found") -> DataFrame:
    """Each left row with the value of the right row of its symbol that is latest at or before it.

    Both sides share one stream sorted by time, so there is one shuffle by symbol and no range join.
    """
    tagged = left.withColumns({"side_": F.lit(1), "value_": F.lit(None).cast(right.schema[value].dataType)})
    events = right.select(F.col(by), F.col(at), F.lit(0).alias("side_"), F.col(value).alias("value_"))
    stream = tagged.unionByName(events, allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy(at, "side_").rowsBetween(Window.unboundedPreceding, 0)
    return stream.withColumn(out, F.last("value_", ignorenulls=True).over(order)).where("side_ = 1").drop("side_", "value_")


def forward_adjust(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Prices scaled by the cumulative factor in force over the latest one; volume by its inverse.

    events: symbol, eob (ex date), cum_factor, factor. Before a symbol's first event the factor in force
    is the first cumulative factor over the first event's own factor; symbols without events stay.
    """
    ends = events.groupBy("symbol").agg(F.max_by("cum_factor", "eob").alias("latest_"), F.min_by(F.col("cum_factor") / F.col("factor"), "eob").alias("first_"))
    rows = as_of(bars, events, "cum_factor", out="cum_").join(ends, "symbol", "left")
    scale = F.coalesce(ratio(F.coalesce("cum_", "first_"), F.col("latest_")), F.lit(1.0))
    rows = rows.withColumn("ratio", scale)
    return rows.withColumns({c: F.col(c) * F.col("ratio") for c in ("open", "high", "low", "close")} | {"volume": ratio("volume", "ratio")}).drop("cum_", "latest_", "first_")


def resample(bars: DataFrame, bucket: Column) -> DataFrame:
    """Bars of a coarser grid: first open, highest, lowest, last close, summed volume."""
    return bars.groupBy("symbol", bucket.alias("bar")).agg(
        F.min_by("open", "eob").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "eob").alias("close"), F.sum("volume").alias("volume"),
    )


def minutes_of_day(at: Column) -> Column:
    return F.hour(at) * 60 + F.minute(at)


def resample_5m(minute_bars: DataFrame) -> DataFrame:
    """Five-minute bars, labelled by their right edge, inside the morning and afternoon sessions.

    Minutes 09:31 to 11:30 and 13:01 to 15:00 count; a bucket never spans the pause.
    """
    m = minutes_of_day(F.col("eob"))
    anchor = F.when(m.between(571, 690), 570).when(m.between(781, 900), 780)
    rows = minute_bars.where((F.col("volume") > 0) & anchor.isNotNull())
    edge = anchor + (F.floor((m - anchor - 1) / 5) + 1) * 5
    day = F.date_trunc("day", F.col("eob")).cast("timestamp_ntz")
    return resample(rows, (day + F.make_dt_interval(mins=edge)).cast("timestamp_ntz"))


def last_dates(dates: DataFrame, unit: str) -> DataFrame:
    """The last date of each ISO week or month."""
    key = F.date_trunc(unit, "eob")
    return dates.groupBy(key.alias("k_")).agg(F.max("eob").alias("eob")).select("eob")


def densified(weights: DataFrame, dates: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row for each date and symbol, weights null where there was none; the dates are one row each, of which each symbol gets the list."""
    calendar = dates.agg(F.collect_set("eob")).scalar()
    return symbols.select("symbol", F.explode(calendar).alias("eob")).join(weights, ["eob", "symbol"], "left")


def hold_every(weights: DataFrame, every: int) -> DataFrame:
    """Weights of every N-th date of the calendar, held until the next; 0 before the first. Weights must be dense."""
    dates = weights.select("eob").distinct().withColumn("place_", F.row_number().over(Window.orderBy("eob")) - 1)
    rows = weights.join(F.broadcast(dates), "eob")
    kept = F.when(F.col("place_") % every == 0, F.coalesce("weight", F.lit(0.0)))
    held = F.last("kept_", ignorenulls=True).over(prefix())
    return rows.withColumn("kept_", kept).withColumn("weight", F.coalesce(held, F.lit(0.0))).drop("place_", "kept_")


def month_span() -> Column:
    """Fractional months from the first to the last date."""
    a, b = F.min("eob"), F.max("eob")
    part = lambda d: F.dayofmonth(d) / F.dayofmonth(F.last_day(d))
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) + part(b) - part(a)
