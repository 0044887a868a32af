"""Queries over fitted models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.windows import change, percent_rank
from barloom.operators import cross_section as cs
from barloom.operators import grids as gr
from barloom.operators import models as md
from barloom.plans.panel_queries import FACTORS, rounded, week
from barloom.sources import panels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly factors of all brands with the rank of the next executable return as label."""
    return week(spark, folder).withColumn("label", percent_rank("fwd"))


def returns(spark: SparkSession, folder: str) -> DataFrame:
    return panels.brand_bars(spark, folder).select("symbol", "eob", change().alias("ret"))


@query
def lasso_tracking(spark: SparkSession, folder: str) -> DataFrame:
    """Few brands that track the mean weekly change of all, solved at each month's end."""
    rows = returns(spark, folder).where("ret IS NOT NULL")
    return rounded(md.lasso_track(rows, rows.groupBy("eob").agg(F.avg("ret").alias("ret")), 60, 1e-5, 30))


@query
def component_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(md.expanding_components(ranked(spark, folder), FACTORS, "label", 100, 26, 3, most=3))


@query
def component_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranked(spark, folder)
    return rounded(md.score_metrics(md.expanding_components(rows, FACTORS, "label", 100, 26, 3, most=3), rows, "label"))


@query
def component_weights(spark: SparkSession, folder: str) -> DataFrame:
    """The two highest scores of each date in equal parts."""
    scored = md.expanding_components(ranked(spark, folder), FACTORS, "label", 100, 26, 3, most=3, models=("ols",))
    return rounded(cs.top_n(scored, "score", 2).select("symbol", "eob", "weight"))


@query
def component_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(md.component_sweep(ranked(spark, folder), FACTORS, "label", list(range(1, len(FACTORS) + 1))))


@query
def boosted_barriers(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of boosted classifiers of the triple barrier over all brands' weeks, tested on the weeks from 1997 on."""
    rows = cs.triple_barrier(week(spark, folder), 0.1, 0.1, 5).dropna(subset=["symbol", "eob"])
    return rounded(md.barrier_weights(rows, FACTORS, "label", "1997-01-01", rounds=10), 4)


@query
def learned_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(md.learned_factor(ranked(spark, folder), FACTORS, "label", rounds=8), 4)


@query
def channel_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Eight settings of the channel rule over all brands' weeks, ranked within the sample."""
    bars = panels.brand_bars(spark, folder)
    weights = gr.channel_grid(bars, (10, 20), (5, 15), (14,), (2.0, 3.0))
    return rounded(gr.rank_in_sample(gr.grid_figures(bars, weights)), 5)


@query
def satellite_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen settings of the core and satellite rule, ranked within the sample."""
    bars = panels.brand_bars(spark, folder)
    weights = gr.satellite_grid(bars, (0.2, 0.3), (0.0,), (5, 10), (35.0, 45.0), (1.5,), (0.07,), (0.05, 0.1), (10,), trend=40, slope=5, low=20)
    return rounded(gr.rank_in_sample(gr.grid_figures(bars, weights)), 5)
