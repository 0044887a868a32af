"""The bar store: Parquet partitioned by symbol, CSV import, content-addressed events, plain SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("eob", T.TimestampNTZType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))])


def partitioned(spark: SparkSession, path: str, *keys: str, **options: str) -> DataFrame:
    """A table whose partition columns `keys` are text, whatever their values look like: 000001 stays 000001."""
    reader = spark.read.options(**options)
    fields = [T.StructField(f.name, T.StringType()) if f.name in keys else f for f in reader.parquet(path).schema]
    return reader.schema(T.StructType(fields)).parquet(path)


def save(bars: DataFrame, root: str, frequency: str) -> None:
    """Write bars under root/frequency, replacing the partitions of the symbols they hold and no others."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "eob").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(f"{root}/{frequency}")


def read(spark: SparkSession, root: str, frequency: str, symbols: list[str] | None = None) -> DataFrame:
    """Bars of the given symbols (all if None); partitions are pruned; symbols that are missing raise together."""
    bars = partitioned(spark, f"{root}/{frequency}", "symbol")
    if symbols is None:
        return bars
    if not symbols:
        raise ValueError("no symbols asked for")
    bars = bars.where(F.col("symbol").isin(symbols))
    found = {r["symbol"] for r in bars.select("symbol").distinct().collect()}  # at most as many as were asked for
    if missing := sorted(set(symbols) - found):
        raise FileNotFoundError(f"no bars of {missing}")
    return bars


def from_csv(spark: SparkSession, path: str, zone: str = "Asia/Shanghai") -> DataFrame:
    """Bars from a CSV with UTC times, brought to the zone's wall clock."""
    raw = spark.read.csv(path, header=True, schema="symbol string, eob timestamp, open double, high double, low double, close double, volume double")
    return raw.withColumn("eob", F.from_utc_timestamp("eob", zone).cast("timestamp_ntz"))


def sql(spark: SparkSession, folder: str, text: str, tables: tuple[str, ...]) -> DataFrame:
    """A SELECT over the named tables of a folder; views get names of their own, so calls do not meet."""
    mark = uuid4().hex[:8]
    head = []
    for t in tables:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(f"{t}_{mark}")
        head.append(f"{t} AS (SELECT * FROM {t}_{mark})")
    try:
        return spark.sql(f"WITH {', '.join(head)} {text}")
    finally:
        for t in tables:
            spark.catalog.dropTempView(f"{t}_{mark}")


def import_combined(spark: SparkSession, path: str, root: str, frequency: str, zone: str = "Asia/Shanghai") -> list[str]:
    """Bars of many symbols from one CSV, saved symbol by symbol; the names of the symbols that came in."""
    bars = from_csv(spark, path, zone)
    save(bars, root, frequency)
    return [r["symbol"] for r in bars.select("symbol").distinct().orderBy("symbol").collect()]


def market(spark: SparkSession, root: str, frequency: str, text: str, symbols: list[str] | None = None) -> DataFrame:
    """A SELECT over the view `market`: the stored bars of a frequency, of the given symbols or of all.

    The view has a name of its own while the text is resolved, and is gone when the plan is there.
    """
    mark = f"market_{uuid4().hex[:8]}"
    read(spark, root, frequency, symbols).createOrReplaceTempView(mark)
    try:
        return spark.sql(f"WITH market AS (SELECT * FROM {mark}) {text}")
    finally:
        spark.catalog.dropTempView(mark)


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of the left side that the right side lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def coverage(expected: DataFrame, observed: DataFrame, excused: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that were neither seen nor excused."""
    return missing_keys(expected, observed.select(*keys).unionByName(excused.select(*keys)), keys)


def timeouts(results: DataFrame, threshold: int) -> DataFrame:
    """Keys whose failed requests timed out `threshold` times or more."""
    late = results.where((F.col("status") == "failed") & F.lower("error").contains("timed out"))
    return late.groupBy("symbol", "date").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


def chained(events: DataFrame) -> DataFrame:
    """Events with a digest of their content and the digest before, by stream; seq orders a stream."""
    digest = F.sha2(F.concat_ws("|", "stream", F.col("seq").cast("string"), "payload"), 256)
    rows = events.withColumn("digest", digest)
    return rows.withColumn("previous", F.lag("digest").over(Window.partitionBy("stream").orderBy("seq")))


def broken(log: DataFrame) -> DataFrame:
    """Events of a log whose digest, link or number is not what its stream says."""
    again = chained(log.select("stream", "seq", "payload")).select("stream", "seq", F.col("digest").alias("d_"), F.col("previous").alias("p_"))
    step = F.col("seq") - F.lag("seq", 1).over(Window.partitionBy("stream").orderBy("seq"))
    rows = log.withColumn("step_", step).join(again, ["stream", "seq"])
    bad = ~F.col("digest").eqNullSafe(F.col("d_")) | ~F.col("previous").eqNullSafe(F.col("p_")) | (F.coalesce("step_", F.lit(1)) != 1)
    return rows.where(bad).select("stream", "seq")


def compacted(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest version of each key, as an upsert leaves it."""
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))
    return rows.withColumn("n_", latest).where("n_ = 1").drop("n_")


def list_symbols(spark: SparkSession, root: str, frequency: str) -> DataFrame:
    """The stored symbols of a frequency, in order."""
    return read(spark, root, frequency).select("symbol").distinct().orderBy("symbol")


_TESTED = ("IC_mean", "IC_IR", "t_stat", "long_short_return")


def best_factors(summary: DataFrame, namespace: str, least: float = 0.3) -> DataFrame:
    """Factors of a namespace whose |IC_IR| is above `least`, the strongest first."""
    rows = summary.where((F.col("namespace") == namespace) & (F.abs("IC_IR") > least))
    return rows.select("factor_id", *_TESTED).orderBy(F.abs("IC_IR").desc(), "factor_id")


def across_namespaces(summary: DataFrame, factor: str) -> DataFrame:
    """A factor's results in every namespace that tested it, the strongest first."""
    return summary.where(F.col("factor_id") == factor).select("namespace", *_TESTED).orderBy(F.abs("IC_IR").desc_nulls_last(), "namespace")
