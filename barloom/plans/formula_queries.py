"""Queries over formulas and plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.oracle import BRAND_WEEK, div, lag, pct_rank, roll
from barloom.plans import formula
from barloom.sources import panels, store

CLOSE = {"field": "close"}
TREE = {"op": "-", "args": [{"call": "rank", "args": [{"op": "/", "args": [CLOSE, {"call": "mean", "args": [CLOSE], "n": 8}]}]}, {"call": "tanh", "args": [{"call": "lag", "args": [{"call": "std", "args": [{"field": "volume"}], "n": 6}], "n": 2}]}]}


def formula_eval(spark: SparkSession, folder: str) -> DataFrame:
    out = formula.evaluate(panels.brand_bars(spark, folder), TREE)
    return out.select("symbol", "eob", F.round("value", 6).alias("value"))


TEXT = """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate >= DATE '1996-01-01' GROUP BY n_name HAVING count(*) > 3"""


def sql_passthrough(spark: SparkSession, folder: str) -> DataFrame:
    """Plain SQL over a folder's tables."""
    return store.sql(spark, folder, TEXT, ("orders", "customer", "nation"))


QUERIES = {"formula_eval": formula_eval, "sql_passthrough": sql_passthrough}
ORACLE_SQL = {
    "formula_eval": f"WITH {BRAND_WEEK}, a AS (SELECT *, {div('close', roll('avg', 'close', 8))} AS q, {roll('stddev_samp', 'volume', 6)} AS s FROM bars), b AS (SELECT *, {pct_rank('q')} AS k, {lag('s', 2)} AS l FROM a) SELECT symbol, eob, round(k - tanh(l), 6) AS value FROM b",
    "sql_passthrough": TEXT,
}
