"""The streaming bars, as a batch over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.sources import panels
from barloom.streaming import bars


def stream_hour_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The streaming plan on a bounded table; tests hold the running stream against it."""
    return bars.stream_bars(panels.table(spark, folder, "events"))


QUERIES = {"stream_hour_bars": stream_hour_bars}
ORACLE_SQL = {
    "stream_hour_bars": "SELECT event_type AS symbol, date_trunc('hour', ts) + INTERVAL 1 HOUR AS eob, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL",
}
