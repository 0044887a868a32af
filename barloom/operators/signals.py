"""From signals and controls to books: signed signals, predictions run through the backtest, chains of risk controls, what a ledger holds, factor frames, one report on a factor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.indicators import INDICATORS
from barloom.operators import checks as ck
from barloom.operators.cross_section import rank_ic, summarize_ic
from barloom.operators.evaluation import robustness
from barloom.operators.portfolio import daily_result
from barloom.operators.strategies import exposure_control, predicted_positions, scaled
from barloom.plans import formula
from barloom.session import cut

#: Trading dates between rebalances.
STEPS = {"D": 1, "W": 5, "M": 22}


def rebalance_step(every: int | str) -> int:
    """The dates between rebalances: a letter of STEPS in either case, or a positive whole number."""
    try:
        step = STEPS.get(every.upper()) or int(every) if isinstance(every, str) else int(every)
    except ValueError as error:
        raise ValueError(f"neither a step nor one of {sorted(STEPS)}: {every!r}") from error
    if step < 1:
        raise ValueError(f"the step must be positive: {every!r}")
    return step


def signal_weights(df: DataFrame, signal: str, exposure: float = 1.0) -> DataFrame:
    """The rows with weights: the signal held between -1 and 1, nothing where it is missing, times the exposure."""
    x = F.coalesce(F.col(signal).cast("double"), F.lit(0.0))
    return df.withColumn("weight", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * exposure)


def prediction_backtest(df: DataFrame, reverse: list[tuple[float, float]] = (), drop: list[tuple[float, float]] = (), delay: int = 1, cost_rate: float = 0.0007) -> DataFrame:
    """Daily results of positions taken from predictions (label, score) of each symbol, in equal parts; the delay stands in the positions, so they act at once."""
    rows = signal_weights(predicted_positions(df, reverse, drop, delay), "position")
    share = F.lit(1.0) / F.count("*").over(Window.partitionBy("eob"))
    return daily_result(rows.withColumn("weight", F.col("weight") * share), signal_lag=0, cost_rate=cost_rate)


def weight_counts(weights: DataFrame) -> DataFrame:
    """On how many dates each symbol has a positive weight; symbols without one have 0."""
    return weights.groupBy("symbol").agg(F.sum((F.coalesce(F.col("weight"), F.lit(0.0)) > 0).cast("long")).alias("dates"))


def weights_near(weights: DataFrame, date: str) -> DataFrame:
    """The positive weights of the date of the ledger that is nearest to the given one, the earlier of two: symbol, eob, weight."""
    away = F.abs(F.datediff("eob", F.lit(date).cast("date")))
    nearest = weights.agg(F.min_by("eob", F.struct(away, F.col("eob"))).alias("d")).scalar()
    return weights.where((F.col("eob") == nearest) & (F.col("weight") > 0)).select("symbol", "eob", "weight")


#: Controls by name: functions that give a scale of each date for a dense book.
CONTROLS: dict[str, Callable[..., DataFrame]] = {"universe_vol_exposure": exposure_control}


def controlled(df: DataFrame, controls: list[tuple[str, dict]]) -> DataFrame:
    """A dense book with the controls applied one behind the other, each on what the one before left: its rows with `weight` and, for each control, whether it acted.

    controls: name and arguments. A control that is not known raises.
    """
    out = df
    for k, (name, args) in enumerate(controls):
        if name not in CONTROLS:
            raise ValueError(f"unknown control: {name}")
        out = cut(out)  # the control and the book it scales
        daily = CONTROLS[name](out, **args)
        out = scaled(out.join(daily.select("eob", F.col("active").alias(f"active_{k}")), "eob", "left"), daily)
    return out


def factor_frame(bars: DataFrame, factors: dict[str, tuple[str, dict]]) -> DataFrame:
    """The bars with a column factor__name for each named indicator and its arguments; window indicators share one sort."""
    out = bars
    for name, (indicator, args) in factors.items():
        if indicator not in INDICATORS:
            raise ValueError(f"unknown indicator: {indicator}")
        out = INDICATORS[indicator](out, **args).withColumnRenamed("value", f"factor__{name}")
    return out


REPORT = ("part", "name", "value", "passed")


def preflight(bars: DataFrame, tree: dict, required: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Findings on a panel and a formula before anything is evaluated: part, name, value, passed. A formula that is not allowed is a finding, not an error."""
    spark = bars.sparkSession
    try:
        nodes, fault = formula.check(tree), None
    except ValueError as error:
        nodes, fault = None, str(error)
    own = spark.createDataFrame([("formula", "nodes" if fault is None else fault, float(nodes) if nodes else None, fault is None)], "part string, name string, value double, passed boolean")
    rules = ck.validate_panel(bars, required).select(F.lit("panel").alias("part"), F.col("code").alias("name"), F.col("detail").try_cast("double").alias("value"), F.col("passed") | (F.col("severity") != ck.HARD))
    return rules.toDF(*REPORT).unionByName(own)


def factor_report(bars: DataFrame, tree: dict, forward: Column, cuts: list, regimes: dict[str, Column] | None = None, least: int = 5) -> DataFrame:
    """Everything on a formula in one long table (part, name, value, passed): the panel's rules, causality at the cuts, alignment of its values, daily rank ICs and their means in slices.

    The formula is worked out once for the parts that read its values; the causality check runs it on the prefixes.
    """
    values = cut(formula.evaluate(bars, tree).withColumn("fwd", forward))
    causal = ck.prefix_causality(bars, lambda df: formula.evaluate(df, tree), cuts=cuts)
    causal = causal.select(F.lit("causality").alias("part"), F.col("cut").cast("string").alias("name"), F.col("changed").cast("double").alias("value"), "passed")
    aligned = ck.alignment(bars, values).select(F.lit("alignment").alias("part"), F.col("code").alias("name"), F.col("detail").cast("double").alias("value"), F.col("passed") | (F.col("severity") != ck.HARD)).toDF(*REPORT)
    ics = summarize_ic(rank_ic(values, "value", "fwd", least).withColumn("all_", F.lit(1)), ("all_",)).drop("all_")
    ics = ics.select(F.explode(F.array(*[F.struct(F.lit("ic").alias("part"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ics.columns])).alias("c")).select("c.*")
    slices = robustness(values, "value", "fwd", regimes, least=least).select(F.lit("slice").alias("part"), F.col("slice").alias("name"), F.col("ic_mean").alias("value"))
    out = preflight(bars, tree).unionByName(causal).unionByName(aligned)
    return out.unionByName(ics.unionByName(slices).withColumn("passed", F.lit(None).cast("boolean")))
