"""Queries over signals, controls, ledgers and the report on a factor, with their SQL for DuckDB."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.oracle import BRAND_WEEK, change, div, lag, lead
from barloom.functions.windows import change as changed, lead as lead_of, ratio
from barloom.operators import signals as sg
from barloom.plans import strategy_queries
from barloom.plans.panel_queries import HELD, WEEK, held, rounded, week
from barloom.plans.stored_queries import fresh_root
from barloom.sources import panels, research_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


@query(f"WITH {BRAND_WEEK} SELECT symbol, eob, round(greatest(-1, least(1, coalesce(50 * {change()}, 0))) * 0.5, 6) AS weight FROM bars")
def signal_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Half of each brand's signal, fifty times its weekly change held between -1 and 1."""
    rows = panels.brand_bars(spark, folder).withColumn("signal", 50 * changed())
    return rounded(sg.signal_weights(rows, "signal", 0.5).select("symbol", "eob", "weight"))


_POSITIONS = strategy_queries.ORACLE_SQL["predicted_positions"]


@query(f"""{_POSITIONS.rpartition('SELECT symbol, eob, CAST')[0].rstrip()}, po AS (SELECT symbol, eob, close, coalesce(last_value(pos IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY eob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM q),
w AS (SELECT *, greatest(-1, least(1, position)) / count(*) OVER (PARTITION BY eob) AS w, {div(lead('close'), 'close')} - 1 AS f FROM po), t AS (SELECT *, abs(w - coalesce({lag('w')}, 0)) AS t FROM w)
SELECT eob, round(sum(w * f), 6) AS gross, round(sum(t), 6) AS turnover, round(sum(t) * 0.0007, 6) AS cost, round(sum(w * f) - sum(t) * 0.0007, 6) AS ret FROM t GROUP BY eob HAVING sum(w * f) IS NOT NULL""")
def prediction_backtest(spark: SparkSession, folder: str) -> DataFrame:
    """Daily results of positions by the sign of momentum, turned or dropped by a score."""
    rows = week(spark, folder).withColumns({"label": F.when(F.col("mom") > 0, 1).when(F.col("mom") <= 0, -1), "score": F.col("gap")})
    return rounded(sg.prediction_backtest(rows, [(0.3, 0.5)], [(-0.02, 0.0)]))


@query(f"WITH {HELD} SELECT symbol, count(*) FILTER (weight > 0) AS dates FROM held GROUP BY symbol")
def weight_counts(spark: SparkSession, folder: str) -> DataFrame:
    return sg.weight_counts(held(spark, folder))


@query(f"WITH {HELD}, n AS (SELECT eob FROM held ORDER BY abs(eob - DATE '1996-05-15'), eob LIMIT 1) SELECT symbol, eob, round(weight, 6) AS weight FROM held SEMI JOIN n USING (eob) WHERE weight > 0")
def weights_near(spark: SparkSession, folder: str) -> DataFrame:
    """The book of the date nearest to one on which there is none."""
    return rounded(sg.weights_near(held(spark, folder), "1996-05-15"))


_SCALED = strategy_queries.ORACLE_SQL["exposure_control"].rpartition("SELECT eob, active")[0].rstrip()


@query(f"{_SCALED} SELECT h.symbol, h.eob, round(h.weight * CASE WHEN z.active AND z.before > 0 THEN least(0.004 / z.before, 1) ELSE 1 END, 8) AS weight, z.active FROM held h JOIN z USING (eob)")
def controlled_weights(spark: SparkSession, folder: str) -> DataFrame:
    """A book whose gross weight is held down on volatile dates."""
    out = sg.controlled(held(spark, folder), [("universe_vol_exposure", {"gross": 0.004})])
    return out.select("symbol", "eob", F.round("weight", 8).alias("weight"), F.col("active_0").alias("active"))


@query(f"WITH {BRAND_WEEK} SELECT symbol, eob, round({change('close', 20)}, 6) AS factor__mom, round({change('close', 5)}, 6) AS factor__fast FROM bars")
def factor_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Two settings of one indicator as columns of one frame."""
    out = sg.factor_frame(panels.brand_bars(spark, folder), {"mom": ("momentum_score", {}), "fast": ("momentum_score", {"lookback": 5})})
    return rounded(out.select("symbol", "eob", "factor__mom", "factor__fast"))


@query(f"WITH {BRAND_WEEK} SELECT symbol, eob, round({WEEK['fwd']}, 6) AS value FROM bars")
def stored_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Forward returns as labels, stored and read back."""
    root = fresh_root(spark)
    research_store.save_factor(week(spark, folder).select("symbol", "eob", F.col("fwd").alias("value")), root, "labels", "fwd", {"horizon": 1})
    return rounded(research_store.read_factor(spark, root, "labels", "fwd", {"horizon": 1}))


@query()
def factor_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report on a formula: the distance of the close from its mean, ranked on each date."""
    tree = {"call": "rank", "args": [{"op": "/", "args": [{"field": "close"}, {"call": "mean", "args": [{"field": "close"}], "n": 10}]}]}
    cuts = [datetime.date(1996, 1, 1), datetime.date(1997, 12, 29)]
    forward = ratio(lead_of("close", 2), lead_of("close", 1)) - 1
    return rounded(sg.factor_report(panels.brand_bars(spark, folder), tree, forward, cuts, {"early": F.col("eob") < F.lit("1995-01-01").cast("date")}))
