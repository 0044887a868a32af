"""The research store: factors, factor tests, correlations, backtests, adjustment events and model metadata as Parquet and JSON under one root.

Summaries are logs: a result is appended, and of the rows of one key a reader takes the latest. Writers thus
rewrite nothing that others read. A namespace keeps the results of one study apart.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.sources.store import compacted, partitioned

YEAR = 252


def _at(root: str, *parts: str) -> str:
    """A path under the root; each part is one plain segment."""
    for part in parts:
        if not part or part in (".", "..") or re.search(r"[/\\]", part):
            raise ValueError(f"not a path segment: {part!r}")
    return "/".join((root, *parts))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where nothing is stored."""
    try:
        return partitioned(spark, path, "symbol", "namespace", "run")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _found(spark: SparkSession, path: str) -> DataFrame:
    rows = _read(spark, path)
    if rows is None:
        raise FileNotFoundError(path)
    return rows


def factor_key(name: str, params: dict[str, Any] | None = None) -> str:
    """A factor's file name: its name and a digest of its parameters, whatever their order."""
    text = json.dumps(params or {}, sort_keys=True, separators=(",", ":"), default=str)
    return f"{name}_{hashlib.sha256(text.encode()).hexdigest()[:16]}"


# ---- adjustment events


def save_adjustments(events: DataFrame, root: str) -> None:
    """Events with symbol and ex_date, replacing those of the symbols they hold and no others."""
    events.repartition("symbol").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(_at(root, "adj_factor"))


def read_adjustments(spark: SparkSession, root: str, symbol: str) -> DataFrame:
    rows = _found(spark, _at(root, "adj_factor")).where(F.col("symbol").cast("string") == symbol)
    if rows.isEmpty():
        raise FileNotFoundError(f"no adjustment events of {symbol}")
    return rows


def list_adjustments(spark: SparkSession, root: str) -> list[str]:
    """The symbols with events; one name each reaches the driver."""
    rows = _read(spark, _at(root, "adj_factor"))
    return [] if rows is None else [r["symbol"] for r in rows.select(F.col("symbol").cast("string").alias("symbol")).distinct().orderBy("symbol").collect()]


# ---- factors


def save_factor(values: DataFrame, root: str, namespace: str, name: str, params: dict[str, Any] | None = None) -> None:
    """A factor's rows (symbol, eob, value), replacing what the same name and parameters stored."""
    values.select("symbol", "eob", "value").write.mode("overwrite").parquet(_at(root, "factors", namespace, factor_key(name, params)))


def read_factor(spark: SparkSession, root: str, namespace: str, name: str, params: dict[str, Any] | None = None) -> DataFrame | None:
    """A stored factor, or None."""
    return _read(spark, _at(root, "factors", namespace, factor_key(name, params)))


def test_summary(ic: DataFrame, groups: DataFrame) -> DataFrame:
    """One row on a factor's daily ICs (eob, ic) and the daily returns of its groups (eob, grp, ret)."""
    last = F.max("eob").over(Window.partitionBy())  # one row a date
    recent = F.when(F.col("eob") > F.add_months("last_", -12), F.col("ic"))
    dated = ic.withColumn("last_", last)
    ir = lambda x: F.try_divide(F.avg(x), F.stddev_samp(x))
    stats = dated.agg(
        F.avg("ic").alias("IC_mean"), F.stddev_samp("ic").alias("IC_std"), ir("ic").alias("IC_IR"), F.avg(recent).alias("IC_mean_last_1y"), ir(recent).alias("IC_IR_LAST_1Y"),
        F.avg((F.col("ic") > 0).cast("double")).alias("IC_positive_ratio"), F.avg((F.abs("ic") > 0.02).cast("double")).alias("IC_abs_gt_2pct"),
        (ir("ic") * F.sqrt(F.count("ic"))).alias("t_stat"), F.count("ic").alias("IC_count"),
    )
    grown = groups.groupBy("grp").agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("r"))  # one row a group
    sides = grown.agg(F.max_by("r", "grp").alias("top_group_cum_return"), F.min_by("r", "grp").alias("bottom_group_cum_return"))
    return stats.join(F.broadcast(sides)).withColumn("long_short_return", F.col("top_group_cum_return") - F.col("bottom_group_cum_return"))


def save_factor_test(root: str, namespace: str, factor: str, ic: DataFrame, groups: DataFrame, n: int = 1, g: int = 5, turnover: DataFrame | None = None) -> None:
    """A factor's ICs, group returns and turnover, and a row on them in the namespace's log."""
    ic.select("eob", "ic").write.mode("overwrite").parquet(_at(root, "factor_test", namespace, "ic", f"{factor}__n{n}"))
    groups.select("eob", "grp", "ret").write.mode("overwrite").parquet(_at(root, "factor_test", namespace, "group_return", f"{factor}__n{n}_g{g}"))
    if turnover is not None:
        turnover.write.mode("overwrite").parquet(_at(root, "factor_test", namespace, "turnover", f"{factor}__n{n}_g{g}"))
    head = [F.lit(factor).alias("factor_id"), F.lit(n).cast("long").alias("n"), F.lit(g).cast("long").alias("g")]
    row = test_summary(ic, groups).select(*head, "*", F.current_timestamp().alias("tested_at"))
    row.write.mode("append").parquet(_at(root, "factor_test_summary", f"namespace={namespace}"))


def read_ics(spark: SparkSession, root: str, namespace: str, factor: str, n: int = 1) -> DataFrame:
    return _found(spark, _at(root, "factor_test", namespace, "ic", f"{factor}__n{n}"))


def read_group_returns(spark: SparkSession, root: str, namespace: str, factor: str, n: int = 1, g: int = 5) -> DataFrame:
    return _found(spark, _at(root, "factor_test", namespace, "group_return", f"{factor}__n{n}_g{g}"))


def factor_tests(spark: SparkSession, root: str, where: str = "true") -> DataFrame | None:
    """The latest row of each namespace, factor and setting that meets a condition; None if nothing was tested."""
    rows = _read(spark, _at(root, "factor_test_summary"))
    return None if rows is None else compacted(rows, ["namespace", "factor_id", "n", "g"], "tested_at").where(where)


# ---- correlations


def save_correlation(table: DataFrame, root: str, namespace: str, rank: bool = True) -> None:
    """Correlations of factors (factor_a, factor_b, correlation), by ranks or by values."""
    table.write.mode("overwrite").parquet(_at(root, "correlation", namespace, "spearman" if rank else "pearson"))


def read_correlation(spark: SparkSession, root: str, namespace: str, rank: bool = True) -> DataFrame | None:
    return _read(spark, _at(root, "correlation", namespace, "spearman" if rank else "pearson"))


# ---- backtests


def save_backtest(root: str, namespace: str, daily: DataFrame, weights: DataFrame, metrics: DataFrame, description: str = "", **config: Any) -> str:
    """A run's daily results and weights, and its metrics (one row) in the log; returns the run's id."""
    run = uuid4().hex
    daily.write.parquet(_at(root, "backtest", namespace, "runs", run))
    weights.write.parquet(_at(root, "backtest", namespace, "weights", run))
    head = [F.lit(run).alias("run_id"), F.lit(description).alias("description"), F.lit(json.dumps(config, sort_keys=True, default=str)).alias("config")]
    metrics.select(*head, "*", F.current_timestamp().alias("created_at")).write.mode("append").parquet(_at(root, "backtest_summary", f"namespace={namespace}"))
    return run


def read_backtest(spark: SparkSession, root: str, namespace: str, run: str) -> DataFrame:
    return _found(spark, _at(root, "backtest", namespace, "runs", run))


def read_backtest_weights(spark: SparkSession, root: str, namespace: str, run: str) -> DataFrame:
    return _found(spark, _at(root, "backtest", namespace, "weights", run))


def backtests(spark: SparkSession, root: str, where: str = "true") -> DataFrame | None:
    """The runs of all namespaces that meet a condition, or None if there is none."""
    path = _at(root, "backtest_summary")
    if _read(spark, path) is None:
        return None
    return partitioned(spark, path, "namespace", "run", mergeSchema="true").where(where)  # runs may have further metrics


# ---- models, clearing


def list_models(spark: SparkSession, root: str, namespace: str) -> DataFrame | None:
    """The metadata of a namespace's models, the newest first; None if there is none."""
    try:
        rows = spark.read.option("multiLine", "true").json(_at(root, "models", namespace) + "/*/metadata.json")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows.orderBy(F.desc("created_at")) if "created_at" in rows.columns else rows


def model_metadata(spark: SparkSession, root: str, namespace: str, model: str) -> dict[str, Any]:
    path = _at(root, "models", namespace, model) + "/metadata.json"
    try:
        return spark.read.option("multiLine", "true").json(path).first().asDict(recursive=True)
    except AnalysisException as error:
        raise FileNotFoundError(path) from error


def clear_namespace(spark: SparkSession, root: str, namespace: str) -> list[str]:
    """Delete a namespace's factors, tests and correlations (not its backtests) and return the paths that went."""
    gone = []
    for path in (_at(root, "factors", namespace), _at(root, "factor_test", namespace), _at(root, "factor_test_summary", f"namespace={namespace}"), _at(root, "correlation", namespace)):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(where) and files.delete(where, True):
            gone.append(path)
    return gone
