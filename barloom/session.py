"""Session settings for the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: AQE coalesces small shuffle partitions and splits skewed joins; times are zone-free, so the zone is pinned.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, name: str = "barloom", **more: str) -> SparkSession:
    """A session with the engine's settings; `more` overrides them (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """The rows written once to the session's checkpoint folder, so that the branches of a plan behind them do not work them out again.

    The folder is the one that spark.checkpoint.dir names; where none is named (tests), one in the warehouse.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return df.checkpoint()
