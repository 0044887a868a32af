"""Portfolios: weighting, overlays, exits, backtests and their metrics, on long (symbol, eob) rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import by_date, change, dates, dates_prefix, lag, lead, prefix, ratio, rolling, series
from barloom.session import cut

YEAR = 252
#: Weights and moves up to this are none.
TINY = 1e-12


def normalized(x: str) -> Column:
    """x as a share of its date's sum; 0 where that is 0."""
    return F.coalesce(F.try_divide(F.col(x), F.sum(x).over(by_date())), F.lit(0.0))


def inverse_risk(df: DataFrame, selected: str, lookback: int = 60, least: int = 20, power: int = 1) -> DataFrame:
    """Weights of the selected symbols by the inverse of their return deviation (power 1) or variance (power 2)."""
    df = df.withColumn("r_", change())
    df = df.withColumn("s_", rolling(F.stddev_samp if power == 1 else F.var_samp, "r_", lookback, least))
    df = df.withColumn("i_", F.when(F.col(selected) > 0, F.try_divide(F.lit(1.0), F.col("s_"))))
    return df.withColumn("weight", normalized("i_")).drop("r_", "s_", "i_")


def executed(df: DataFrame, weight: str = "weight", signal_lag: int = 1) -> Column:
    """A weight that acts `signal_lag` rows later; the panel must be dense."""
    return F.coalesce(lag(weight, signal_lag) if signal_lag else F.col(weight), F.lit(0.0))


def daily_result(df: DataFrame, weight: str = "weight", signal_lag: int = 1, cost_rate: float = 0.0004) -> DataFrame:
    """Return, turnover and cost of each date of a dense panel; returns run to the next bar.

    Two steps by symbol share one sort, then a sum by date combines on the map side.
    """
    rows = df.withColumns({"w_": executed(df, weight, signal_lag), "f_": ratio(lead("close"), F.col("close")) - 1})
    rows = rows.withColumn("t_", F.abs(F.col("w_") - F.coalesce(lag("w_"), F.lit(0.0))))
    daily = rows.groupBy("eob").agg(F.sum(F.col("w_") * F.col("f_")).alias("gross"), F.sum("t_").alias("turnover"))
    daily = daily.where("gross IS NOT NULL")
    return daily.select("eob", "gross", "turnover", (F.col("turnover") * cost_rate).alias("cost"), (F.col("gross") - F.col("turnover") * cost_rate).alias("ret"))


def equity(daily: DataFrame, ret: str = "ret") -> DataFrame:
    """Compounded equity, its high and the drawdown from it."""
    rows = daily.withColumn("equity", F.product(1 + F.col(ret)).over(dates_prefix()))
    rows = rows.withColumn("high", F.max("equity").over(dates_prefix()))
    return rows.withColumn("drawdown", 1 - F.col("equity") / F.col("high"))


def metrics(daily: DataFrame, ret: str = "ret") -> DataFrame:
    """One row of performance figures."""
    e = equity(daily, ret)
    out = e.agg(
        F.max_by("equity", "eob").alias("last_"), F.max("drawdown").alias("max_drawdown"), F.avg("turnover").alias("avg_turnover"), F.sum("cost").alias("total_cost"),
        (F.stddev_samp(ret) * math.sqrt(YEAR)).alias("ann_volatility"), (F.stddev_samp(F.least(F.col(ret), F.lit(0.0))) * math.sqrt(YEAR)).alias("down_"),
        F.count("*").alias("days"), F.sum((F.col("turnover") > 1e-8).cast("long")).alias("trade_days"),
    )
    out = out.withColumn("total_return", F.col("last_") - 1).withColumn("ann_return", F.pow(F.col("last_"), F.lit(float(YEAR)) / F.col("days")) - 1)
    return out.select(
        "total_return", "ann_return", "ann_volatility", "max_drawdown", "avg_turnover", "total_cost", "days", "trade_days",
        F.try_divide("ann_return", "ann_volatility").alias("sharpe"), F.try_divide("ann_return", "down_").alias("sortino"), F.try_divide("ann_return", "max_drawdown").alias("calmar"),
    )


def yearly_returns(daily: DataFrame, ret: str = "ret") -> DataFrame:
    return daily.groupBy(F.year("eob").cast("long").alias("year")).agg((F.product(1 + F.col(ret)) - 1).alias("year_return"))


def drawdown_episodes(daily: DataFrame, ret: str = "ret", top: int = 5) -> DataFrame:
    """The deepest falls below a high: peak, trough, recovery date and depth."""
    e = equity(daily, ret).withColumn("new_high", (F.col("equity") >= F.col("high")).cast("int"))
    e = cut(e.withColumn("island", F.sum("new_high").over(dates_prefix())))  # one row a date, used twice
    under = e.where("new_high = 0").groupBy("island").agg(F.max("drawdown").alias("depth"), F.min_by("eob", F.struct(F.negative("drawdown"), "eob")).alias("trough"), F.count("*").alias("days"))
    peaks = e.where("new_high = 1").select("island", F.col("eob").alias("peak"), F.lead("eob").over(dates()).alias("recovery"))
    return under.join(peaks, "island", "left").orderBy(F.desc("depth"), "trough").limit(top).select("peak", "trough", "recovery", "depth", "days")


def breadth(df: DataFrame, period: int = 20) -> DataFrame:
    """Share of the symbols with a close that stand above their mean on each date; 0.5 where there is none."""
    rows = df.withColumn("m_", rolling(F.avg, "close", period, max(1, period // 2)))
    above = F.sum(F.coalesce((F.col("close") > F.col("m_")).cast("long"), F.lit(0)))
    return rows.groupBy("eob").agg(F.coalesce(F.try_divide(above, F.count("close")), F.lit(0.5)).alias("breadth"))


def volatility_target(df: DataFrame, target: float = 0.1, lookback: int = 60, least: int = 20) -> DataFrame:
    """Factor of each date, at most 1, that brings the lagged weights' realised volatility to the target."""
    rows = df.withColumns({"w_": lag("weight"), "r_": change()})
    daily = rows.groupBy("eob").agg(F.sum(F.col("w_") * F.col("r_")).alias("p"))
    frame = dates().rowsBetween(-(lookback - 1), 0)
    s = F.when(F.count("p").over(frame) >= least, F.stddev_samp("p").over(frame) * math.sqrt(YEAR))
    return daily.select("eob", F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(target), s)), F.lit(1.0)).alias("scale"))


# ---- exits: each adds a column `exit`


def gap_down(df: DataFrame, gap: float = 0.02, drop: float = 0.03) -> DataFrame:
    p = F.col("p_")
    hit = (ratio(p - F.col("open"), p) > gap) | (ratio(p - F.col("close"), p) > drop)
    return df.withColumn("p_", lag("close")).withColumn("exit", F.coalesce(hit, F.lit(False)).cast("double")).drop("p_")


def volatility_spike(df: DataFrame, short: int = 10, long: int = 60) -> DataFrame:
    df = df.withColumn("r_", change())
    a, b = rolling(F.stddev_samp, "r_", short, short // 2), rolling(F.stddev_samp, "r_", long, long // 2)
    return df.withColumn("exit", F.coalesce(a / F.greatest(b, F.lit(1e-6)), F.lit(1.0))).drop("r_")


def losing_run(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Length of the present run of losing bars."""
    loss = F.coalesce(change() < -threshold, F.lit(False))
    df = df.withColumn("loss_", loss).withColumn("island_", F.sum((~F.col("loss_")).cast("int")).over(prefix()))
    run = F.sum(F.col("loss_").cast("int")).over(Window.partitionBy("symbol", "island_").orderBy("eob").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("exit", run.cast("double")).drop("loss_", "island_")


def drawdown_from_high(df: DataFrame, lookback: int = 20) -> DataFrame:
    return df.withColumn("exit", F.coalesce(1 - ratio("close", F.max("close").over(series().rowsBetween(-(lookback - 1), 0))), F.lit(0.0)))


def hysteresis(df: DataFrame, trigger: float = 2.0, recover: float = 1.5, short: int = 10, long: int = 60) -> DataFrame:
    """1 from the bar at which the volatility ratio reaches `trigger` until it falls to `recover`."""
    df = volatility_spike(df, short, long).withColumnRenamed("exit", "ratio_")
    state = F.when(F.col("ratio_") >= trigger, 1.0).when(F.col("ratio_") <= recover, 0.0)
    return df.withColumn("s_", state).withColumn("exit", F.coalesce(F.last("s_", ignorenulls=True).over(prefix()), F.lit(0.0))).drop("s_", "ratio_")


# ---- sequential rules: state machines over sorted rows


def walked(rows: DataFrame, machine: Callable[[], Callable[..., float]], columns: tuple[str, ...], out: str = "weight") -> DataFrame:
    """symbol, eob and the state that a machine of its own gives at each row of a symbol, in order of time.

    A task streams its sorted symbols and holds one batch; the state is carried from batch to batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, step = None, None
        for batch in batches:
            states = []
            for own, *values in zip(*(batch.column(c).to_pylist() for c in ("symbol", *columns)), strict=True):
                if step is None or own != symbol:
                    symbol, step = own, machine()
                states.append(step(*values))
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), batch.column("eob"), pa.array(states, pa.float64())], ["symbol", "eob", out])

    ordered = rows.select("symbol", "eob", *columns).repartition("symbol").sortWithinPartitions("symbol", "eob")
    return ordered.mapInArrow(run, f"symbol string, eob {dict(rows.dtypes)['eob']}, {out} double")


def told(rows: DataFrame, machine: Callable[[], Callable[..., tuple]], columns: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """As `walked`, of a machine that gives a weight and texts at each row: symbol, eob, weight and the texts `names`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, step = None, None
        for batch in batches:
            made = []
            for own, *values in zip(*(batch.column(c).to_pylist() for c in ("symbol", *columns)), strict=True):
                if step is None or own != symbol:
                    symbol, step = own, machine()
                made.append(step(*values))
            texts = [pa.array([m[i + 1] for m in made], pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), batch.column("eob"), pa.array([m[0] for m in made], pa.float64()), *texts], ["symbol", "eob", "weight", *names])

    ordered = rows.select("symbol", "eob", *columns).repartition("symbol").sortWithinPartitions("symbol", "eob")
    return ordered.mapInArrow(run, f"symbol string, eob {dict(rows.dtypes)['eob']}, weight double, " + ", ".join(f"{n} string" for n in names))


def walked_grid(rows: DataFrame, machines: dict[str, tuple[Callable[[], Callable[..., float]], tuple[str, ...]]], out: str = "weight") -> DataFrame:
    """config, symbol, eob and the state of each of many machines, which all walk a symbol's rows in one pass.

    machines: name -> (a machine's maker, its columns). The columns that machines share are there once; a task
    streams its sorted symbols and holds one batch and one state a machine.
    """
    columns = sorted({c for _, own in machines.values() for c in own})
    places = {name: [columns.index(c) for c in own] for name, (_, own) in machines.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, steps = None, {}
        for batch in batches:
            names, values = batch.column("symbol").to_pylist(), [batch.column(c).to_pylist() for c in columns]
            states: dict[str, list[float]] = {name: [] for name in machines}
            for i, own in enumerate(names):
                if not steps or own != symbol:
                    symbol, steps = own, {name: make() for name, (make, _) in machines.items()}
                row = [v[i] for v in values]
                for name, step in steps.items():
                    states[name].append(step(*[row[p] for p in places[name]]))
            for name, made in states.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(made), pa.string()), batch.column("symbol"), batch.column("eob"), pa.array(made, pa.float64())], ["config", "symbol", "eob", out])

    ordered = rows.select("symbol", "eob", *columns).repartition("symbol").sortWithinPartitions("symbol", "eob")
    return ordered.mapInArrow(run, f"config string, symbol string, eob {dict(rows.dtypes)['eob']}, {out} double")


def reversion_stop(df: DataFrame, ma: int = 10, span: int = 14, multiplier: float = 2.0) -> DataFrame:
    """Position of a reversion rule: long below the mean, out at a stop under the high-water mark of close and high that only rises.

    Flat while mean or range are missing. Mean and range are windows; only the state machine runs in
    Python, over each symbol's sorted rows with its state carried from batch to batch.
    """
    from barloom.functions.indicators import atr

    rows = atr(df, span).withColumnRenamed("value", "range_").withColumn("mean_", rolling(F.avg, "close", ma))

    def machine() -> Callable[..., float]:
        held, mark, stop = 0.0, 0.0, 0.0

        def step(close: float, high: float, mean: float | None, width: float | None) -> float:
            nonlocal held, mark, stop
            if mean is None or width is None:
                return 0.0
            if not held:
                if close < mean:
                    held, mark = 1.0, max(close, high)
                    stop = mark - multiplier * width
            else:
                mark = max(mark, close, high)
                stop = max(stop, mark - multiplier * width)
                if close <= stop:
                    held = 0.0
            return held

        return step

    return walked(rows, machine, ("close", "high", "mean_", "range_"))


def constrained(df: DataFrame, strategy: str = "strategy_id", suspended: str = "suspended", limit_up: str = "limit_up", limit_down: str = "limit_down") -> DataFrame:
    """Day-by-day weights of each strategy: a suspended symbol does not trade, one at its upper limit is not bought, one at its lower limit not sold.

    Buys share the cash that is left. Beside `executed` each row has its date's blocked_buy_weight (what the
    cash could not fill included), blocked_sell_weight and cash_weight. Missing weights are 0, missing flags
    false; rows are dense. The symbols of a date are tied by the cash, so a strategy's dates go in order
    through one task, which holds one date and one batch; strategies run in parallel.
    """

    def day(rows: pd.DataFrame, have: pd.Series) -> tuple[pd.DataFrame, pd.Series]:
        symbols = rows["symbol"].to_numpy()
        old = have.reindex(symbols).fillna(0.0).to_numpy()
        move = rows["weight"].to_numpy() - old
        stuck = rows[suspended].to_numpy()
        no_sell, no_buy = (move < -TINY) & (stuck | rows[limit_down].to_numpy()), (move > TINY) & (stuck | rows[limit_up].to_numpy())
        sell, buy = np.where(no_sell, 0.0, np.clip(-move, 0, None)), np.where(no_buy, 0.0, np.clip(move, 0, None))
        left = np.maximum(old - sell, 0.0)
        cash, need = max(0.0, 1.0 - left.sum()), buy.sum()
        short = max(0.0, need - cash) if need > cash + TINY else 0.0
        now = left + (buy * (cash / need) if short else buy)
        now[np.abs(now) <= TINY] = 0.0
        done = rows[[strategy, "eob", "symbol"]].assign(
            executed=now, blocked_buy_weight=move[no_buy].sum() + short, blocked_sell_weight=-move[no_sell].sum(), cash_weight=max(0.0, 1.0 - now.sum())
        )
        return done, pd.Series(now, symbols)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, own, have = None, None, pd.Series(dtype=float)
        for frame in frames:
            whole = frame if held is None else pd.concat([held, frame], ignore_index=True)
            starts = (whole[[strategy, "eob"]] != whole[[strategy, "eob"]].shift()).any(axis=1).cumsum()
            days = [part for _, part in whole.groupby(starts, sort=False)]
            held, out = days.pop() if days else None, []  # the last date may go on in the next batch
            for part in days:
                have = have if part[strategy].iloc[0] == own else pd.Series(dtype=float)
                own = part[strategy].iloc[0]
                done, have = day(part, have)
                out.append(done)
            if out:
                yield pd.concat(out, ignore_index=True)
        if held is not None:
            yield day(held, have if held[strategy].iloc[0] == own else pd.Series(dtype=float))[0]

    types = dict(df.dtypes)
    flags = {c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in (suspended, limit_up, limit_down)}
    weight = F.when(F.isnan("weight"), 0.0).otherwise(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)))
    rows = df.select(strategy, "eob", "symbol", weight.alias("weight"), *[c.alias(n) for n, c in flags.items()])
    rows = rows.repartition(strategy).sortWithinPartitions(strategy, "eob", "symbol")
    out = f"{strategy} {types[strategy]}, eob {types['eob']}, symbol string, executed double, blocked_buy_weight double, blocked_sell_weight double, cash_weight double"
    return rows.mapInPandas(run, out)


def shrunk_optimum(df: DataFrame, lookback: int = 60, least: int = 20, shrink: float = 0.2) -> DataFrame:
    """Weights of each date that favour the scores of symbols against their shrunk covariance.

    Each date's trailing returns are gathered by an equi-join on the small calendar; one date is a group
    of at most `lookback` rows a symbol, solved with numpy.
    """
    dates = df.select("eob").distinct().withColumn("t", F.row_number().over(Window.orderBy("eob")))
    rows = df.withColumn("r", change()).join(F.broadcast(dates), "eob").select("symbol", "t", "eob", "r", "score")
    ahead = rows.select("symbol", "r", F.explode(F.sequence(F.col("t"), F.col("t") + lookback - 1)).alias("t"), F.col("t").alias("at"))
    joined = ahead.join(rows.select("symbol", "t", "eob", "score"), ["symbol", "t"])

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        now = part.drop_duplicates("symbol").sort_values("symbol")
        wide = part.pivot(index="at", columns="symbol", values="r").dropna()
        score = now.set_index("symbol")["score"].reindex(wide.columns).fillna(0.0).to_numpy()
        n = len(score)
        weights = np.full(n, 1.0 / n) if n else np.empty(0)
        if len(wide) >= least and n > 1 and np.abs(score).sum() > 0:
            cov = np.cov(wide.to_numpy(), rowvar=False)
            spread = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
            corr = (1 - shrink) * cov / np.outer(spread, spread) + shrink * np.eye(n)
            raw = np.clip(np.linalg.solve(corr * np.outer(spread, spread), score), 0, None)
            weights = raw / raw.sum() if raw.sum() > 0 else weights
        return pd.DataFrame({"eob": now["eob"].iloc[0], "symbol": wide.columns, "weight": weights})

    return joined.groupBy("t").applyInPandas(solve, f"eob {dict(df.dtypes)['eob']}, symbol string, weight double")
