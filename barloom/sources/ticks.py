"""Loads of tick data: what is still to be fetched, in batches; the merge of chunks into months; checks of what came.

Everything is a set of rows: activity (symbol, date), stored chunks, results of requests. Nothing here opens a
network; a caller fetches the batches and hands the chunks back as rows.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.sources.store import partitioned

PAIR = ["symbol", "date"]
#: The levels of an order book, which each row has five of.
LEVELS = ("bid_price", "bid_volume", "ask_price", "ask_volume")


def safe_name(symbol: Column | str) -> Column:
    """A symbol as part of a path."""
    return F.translate(F.col(symbol) if isinstance(symbol, str) else symbol, "/:", "__")


def month_key(at: Column | str) -> Column:
    """yyyyMM of a date."""
    return F.date_format(at, "yyyyMM")


def date_ranges(spans: DataFrame, start: str, end: str, years: int = 5) -> DataFrame:
    """The rows once for each segment of at most `years` years of their span: part, from, to. A span that ends before it starts raises."""
    wrong = F.raise_error(F.concat(F.lit("the span ends before it starts: "), F.col(start).cast("string"))).cast("array<struct<from:date,to:date>>")
    count = F.ceil(F.months_between(end, start) / (12 * years)).cast("int")
    ends = F.struct(F.col(start).cast("date").alias("from"), F.lit(None).cast("date").alias("to"))

    def grow(parts: Column, _: Column) -> Column:
        begin = F.element_at(parts, -1)["from"]
        last = F.least(F.add_months(begin, 12 * years), F.col(end).cast("date"))
        return F.when(begin > F.col(end), parts).otherwise(
            F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.struct(begin.alias("from"), last.alias("to")), F.struct(F.date_add(last, 1).alias("from"), F.lit(None).cast("date").alias("to"))))
        )

    parts = F.aggregate(F.sequence(F.lit(0), count), F.array(ends), grow)
    made = F.filter(F.when(F.col(start) > F.col(end), wrong).otherwise(parts), lambda p: p["to"].isNotNull())
    return spans.select("*", F.posexplode(made).alias("part", "p_")).select(*spans.columns, "part", "p_.from", "p_.to")


def effective_start(contracts: DataFrame, requested: str) -> DataFrame:
    """Of each underlying the later of the requested start and its first listing."""
    return contracts.groupBy("underlying").agg(F.greatest(F.lit(requested).cast("date"), F.min("listed_date")).alias("start"))


def prioritized(underlyings: DataFrame, first: list[str]) -> DataFrame:
    """The underlyings with their place in line: those of `first` in its order, then the others by name."""
    wanted = F.array_position(F.array(*[F.lit(x.strip().upper()) for x in first] or [F.lit("")]), F.upper("underlying"))
    return underlyings.withColumn("place", F.row_number().over(Window.orderBy(F.when(wanted > 0, wanted).otherwise(1 << 30), "underlying")))


def plan(activity: DataFrame, stored: DataFrame, excused: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """The symbol-days with activity that are neither stored nor excused: once each; a plan after a partial load gives only the gaps."""
    wanted = activity.select(*PAIR).where("symbol IS NOT NULL AND date IS NOT NULL").distinct()
    if not overwrite:
        wanted = wanted.join(stored.select(*PAIR), PAIR, "left_anti")
    return wanted if excused is None else wanted.join(excused.select(*PAIR), PAIR, "left_anti")


def batches(tasks: DataFrame, size: int = 8) -> DataFrame:
    """Requests of at most `size` symbols of one date: date, batch, symbols in order."""
    place = F.row_number().over(Window.partitionBy("date").orderBy("symbol"))
    numbered = tasks.select(*PAIR).distinct().withColumn("batch", F.floor((place - 1) / size).cast("int"))
    return numbered.groupBy("date", "batch").agg(F.sort_array(F.collect_list("symbol")).alias("symbols"))  # at most `size` names


def without_pairs(requests: DataFrame, excluded: DataFrame) -> DataFrame:
    """The batches without some symbol-days; batches keep their numbers, and those that are left empty go."""
    each = requests.select("date", "batch", F.explode("symbols").alias("symbol")).join(excluded.select(*PAIR), PAIR, "left_anti")
    return each.groupBy("date", "batch").agg(F.sort_array(F.collect_list("symbol")).alias("symbols"))


def no_data(manifest: DataFrame) -> DataFrame:
    """Symbol-days whose latest stored chunk has no rows. manifest: symbol, date, version, rows."""
    latest = manifest.groupBy(*PAIR).agg(F.max_by("rows", "version").alias("rows"))
    return latest.where("rows = 0").select(*PAIR)


def recovered(results: DataFrame, stored: DataFrame) -> DataFrame:
    """Results of requests, in which a failure of a symbol-day that is stored by now is a skip."""
    there = stored.select(*PAIR).distinct().withColumn("there_", F.lit(True))
    skip = (F.col("status") == "failed") & F.col("there_").isNotNull()
    return results.join(there, PAIR, "left").withColumn("status", F.when(skip, "skipped").otherwise(F.col("status"))).drop("there_")


def failed_last(results: DataFrame) -> DataFrame:
    """Symbol-days whose last result is a failure. results: symbol, date, version, status."""
    return results.groupBy(*PAIR).agg(F.max_by("status", "version").alias("status")).where("status = 'failed'").select(*PAIR)


def amount(column: str) -> Column:
    """The sum of a column that may hold text; what is no number counts nothing."""
    return F.coalesce(F.sum(F.floor(F.col(column).try_cast("double"))), F.lit(0)).cast("long")


def merged(existing: DataFrame | None, chunks: DataFrame) -> DataFrame:
    """Stored ticks with chunks laid over them: a symbol-day comes whole from its latest chunk, else from what was stored.

    chunks: the columns of the ticks and `version`. Columns that one side lacks are null. `seq` numbers a symbol's ticks of a month in time.
    """
    latest = chunks.groupBy(*PAIR).agg(F.max("version").alias("version"))
    new = chunks.join(latest, [*PAIR, "version"], "left_semi").drop("version")
    if existing is not None:
        new = existing.drop("seq", "month").join(latest.select(*PAIR), PAIR, "left_anti").unionByName(new, allowMissingColumns=True)
    new = new.withColumn("month", month_key("date"))
    return new.withColumn("seq", F.row_number().over(Window.partitionBy("month", "symbol").orderBy("timestamp", "date")))


def stored_ticks(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return partitioned(spark, f"{root}/monthly", "month", mergeSchema="true")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def merge_months(spark: SparkSession, root: str, chunks: DataFrame) -> None:
    """Lay chunks over the stored months that they touch; other months are not read or written.

    The merged months are written beside the store first, so a run that ends early leaves the stored ones whole.
    """
    existing = stored_ticks(spark, root)
    if existing is not None:
        touched = chunks.select(month_key("date").alias("month")).distinct()
        existing = existing.join(touched, "month", "left_semi")  # pruned to these partitions
    aside = f"{root}/aside-{uuid4().hex}"
    merged(existing, chunks).repartition("month", "symbol").sortWithinPartitions("month", "symbol", "seq").write.partitionBy("month").parquet(aside)
    done = partitioned(spark, aside, "month")
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{root}/monthly")
    where = spark._jvm.org.apache.hadoop.fs.Path(aside)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def month_summary(activity: DataFrame, ticks: DataFrame, stored: DataFrame) -> DataFrame:
    """Of each month with activity: its rows, symbol-days and those without a chunk."""
    pairs = activity.select(*PAIR).distinct().join(stored.select(*PAIR).distinct().withColumn("there_", F.lit(1)), PAIR, "left")
    months = pairs.groupBy(month_key("date").alias("month")).agg(F.count("*").alias("symbol_days"), F.sum(F.when(F.col("there_").isNull(), 1).otherwise(0)).alias("missing_chunks"))
    rows = ticks.groupBy(month_key("date").alias("month")).agg(F.count("*").alias("rows"))
    return months.join(rows, "month", "left").select("month", F.coalesce("rows", F.lit(0)).alias("rows"), "symbol_days", "missing_chunks")


def gaps(activity: DataFrame, ticks: DataFrame, no_rows: DataFrame | None = None, timeouts: DataFrame | None = None) -> DataFrame:
    """Symbol-days with activity that have neither ticks nor an excuse."""
    out = activity.select(*PAIR).distinct().join(ticks.select(*PAIR).distinct(), PAIR, "left_anti")
    for excuse in (no_rows, timeouts):
        out = out if excuse is None else out.join(excuse.select(*PAIR), PAIR, "left_anti")
    return out


def month_faults(activity: DataFrame, ticks: DataFrame, excused: DataFrame | None = None, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """What is wrong with each month: month, reason, rows. Missing files (no tick although unexcused activity), levels that are not five, times that fall within a symbol.

    Ticks are read once: the checks of a row are sums of one aggregation by month, the order of times one window by month and symbol.
    """
    wanted = activity.select(*PAIR).distinct()
    if excused is not None:
        wanted = wanted.join(excused.select(*PAIR), PAIR, "left_anti")
    months = wanted.select(month_key("date").alias("month")).distinct()
    before = F.lag("timestamp").over(Window.partitionBy("month", "symbol").orderBy("seq"))
    rows = ticks.withColumn("month", month_key("date")).withColumn("falls_", F.coalesce(F.col("timestamp") < before, F.lit(False)))
    bad = {f"bad_five_level_{c}": ~F.coalesce(F.size(c) == 5, F.lit(False)) for c in levels if c in ticks.columns} | {"timestamp_not_monotonic": F.col("falls_")}
    sums = rows.groupBy("month").agg(*[F.sum(b.cast("long")).alias(k) for k, b in bad.items()])
    found = sums.select("month", F.explode(F.array(*[F.struct(F.lit(k).alias("reason"), F.col(k).alias("rows")) for k in bad])).alias("f")).select("month", "f.reason", "f.rows").where("rows > 0")
    none = months.join(sums.select("month"), "month", "left_anti").select("month", F.lit("missing_file").alias("reason"), F.lit(0).cast("long").alias("rows"))
    return found.unionByName(none)


def load_report(activity: DataFrame, ticks: DataFrame, no_rows: DataFrame, timeouts: DataFrame, allow_timeouts: bool = False, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """One row on a load: status (ok if nothing is missing or wrong), rows, and symbol-days expected, observed, without data, timed out, missing, and faults."""
    excused = no_rows.select(*PAIR).unionByName(timeouts.select(*PAIR)) if allow_timeouts else no_rows.select(*PAIR)
    wanted = activity.select(*PAIR).distinct()
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(wanted, "expected").crossJoin(count(ticks.select(*PAIR).distinct(), "observed")).crossJoin(count(ticks, "rows"))  # one row each
    for name, df in (("no_data", no_rows), ("timed_out", timeouts)):
        out = out.crossJoin(count(wanted.join(df.select(*PAIR), PAIR, "left_semi"), name))
    out = out.crossJoin(count(gaps(activity, ticks, excused), "missing")).crossJoin(count(month_faults(activity, ticks, excused, levels), "faults"))
    return out.withColumn("status", F.when((F.col("missing") == 0) & (F.col("faults") == 0), "ok").otherwise("failed"))


def retries(activity: DataFrame, missing: DataFrame, faults: DataFrame) -> DataFrame:
    """What to fetch again: the missing symbol-days, or all if none is missing but something is wrong."""
    wanted = activity.select(*PAIR).distinct()
    counts = missing.agg(F.count("*").alias("m_")).crossJoin(faults.agg(F.count("*").alias("f_")))  # one row
    marked = wanted.join(missing.select(*PAIR).withColumn("gone_", F.lit(True)), PAIR, "left").crossJoin(F.broadcast(counts))
    return marked.where(F.col("gone_").isNotNull() | ((F.col("m_") == 0) & (F.col("f_") > 0))).select(*PAIR)
