"""Attribution of profit and loss, and resampling statistics."""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import average_rank, by_date, first_rank, lag, lead, ratio, series


def symbol_pnl(df: DataFrame, cost_rate: float = 0.0004) -> DataFrame:
    """Gross, cost and net profit of each symbol and date, from executed weights and returns to the next bar."""
    rows = df.withColumns({"ret": ratio(lead("close"), F.col("close")) - 1, "moved": F.abs(F.col("weight") - F.coalesce(lag("weight"), F.lit(0.0)))})
    return rows.withColumns({"gross": F.col("weight") * F.col("ret"), "cost": F.col("moved") * cost_rate}).withColumn("net", F.col("gross") - F.col("cost"))


def category_pnl(pnl: DataFrame) -> DataFrame:
    return pnl.groupBy("eob", "category").agg(F.sum("gross").alias("gross"), F.sum("cost").alias("cost"), F.sum("net").alias("net"))


def category_neutral(df: DataFrame) -> DataFrame:
    """Benchmark weights: each category the same, and the same for each of its symbols, on every date."""
    categories = F.size(F.collect_set("category").over(by_date()))
    return df.withColumn("benchmark", 1 / (categories * F.count("*").over(Window.partitionBy("eob", "category"))))


def brinson(df: DataFrame) -> DataFrame:
    """Allocation, selection and interaction of each category and date: weight against benchmark, with returns `ret`."""
    by = df.groupBy("eob", "category").agg(
        F.sum("weight").alias("wp"), F.sum("benchmark").alias("wb"),
        F.try_divide(F.sum(F.col("weight") * F.col("ret")), F.sum("weight")).alias("rp"), F.try_divide(F.sum(F.col("benchmark") * F.col("ret")), F.sum("benchmark")).alias("rb"),
    )
    by = by.withColumns({"rp": F.coalesce("rp", "rb"), "total": F.sum(F.col("wb") * F.col("rb")).over(by_date())})
    return by.select(
        "eob", "category", ((F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("total"))).alias("allocation"),
        (F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"), ((F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))).alias("interaction"),
    )


def actions(df: DataFrame, threshold: float = 1e-9) -> DataFrame:
    """What each date's weight change is: buy, sell, add, reduce, hold or none."""
    d, before = F.col("weight") - F.col("before"), F.col("before")
    kind = (
        F.when((before <= threshold) & (F.col("weight") > threshold), "buy").when((before > threshold) & (F.col("weight") <= threshold), "sell")
        .when(d > threshold, "add").when(d < -threshold, "reduce").when(F.col("weight") > threshold, "hold").otherwise("none")
    )
    return df.withColumn("before", F.coalesce(lag("weight"), F.lit(0.0))).withColumn("action", kind)


def forward_compound(df: DataFrame, windows: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Compounded return of the next bars of each window; null where fewer follow."""
    df = df.withColumn("r_", ratio("close", lag("close")) - 1)
    for k in windows:
        ahead = series().rowsBetween(1, k)
        df = df.withColumn(f"forward_{k}", F.when(F.count("r_").over(ahead) >= k, F.product(1 + F.col("r_")).over(ahead) - 1))
    return df.drop("r_")


def factor_leave_one_out(df: DataFrame, factors: list[str], top: int) -> DataFrame:
    """For each factor how many places of the mean score its absence moves each symbol, and whether that lifts it into the top."""
    total = sum((F.col(f) for f in factors), F.lit(0.0))
    df = df.withColumn("score_", total / len(factors)).withColumn("rank_", first_rank("score_"))
    cells = F.array(*[F.struct(F.lit(f).alias("factor"), ((total - F.col(f)) / (len(factors) - 1)).alias("without")) for f in factors])
    long = df.where("score_ IS NOT NULL").select("symbol", "eob", "rank_", F.explode(cells).alias("c")).select("symbol", "eob", "rank_", "c.*")
    long = long.withColumn("rank_without", first_rank("without", ("factor", "eob")))
    return long.select("symbol", "eob", "factor", (F.col("rank_without") - F.col("rank_")).alias("shift"), ((F.col("rank_") <= top) & (F.col("rank_without") > top)).cast("int").alias("decisive"))


def bucket_attribution(df: DataFrame, score: str, target: str, top: int) -> DataFrame:
    """Mean forward return of the top, the next, the rest and all symbols, by date."""
    place = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).withColumn("place_", first_rank(score))
    own = F.when(F.col("place_") <= top, "top").when(F.col("place_") <= 2 * top, "next").otherwise("rest")
    return place.withColumn("bucket", F.explode(F.array(own, F.lit("universe")))).groupBy("eob", "bucket").agg(F.avg(target).alias("mean_return"), F.count("*").alias("n"))


def top_sensitivity(df: DataFrame, score: str, target: str, tops: list[int]) -> DataFrame:
    """Mean and deviation of the equal-weight top K's return for several K."""
    place = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).withColumn("place_", first_rank(score))
    long = place.withColumn("k", F.explode(F.array(*[F.lit(k) for k in tops]))).where(F.col("place_") <= F.col("k"))
    daily = long.groupBy("k", "eob").agg(F.avg(target).alias("r"))
    return daily.groupBy("k").agg(F.avg("r").alias("mean_return"), F.stddev_samp("r").alias("std_return"), F.count("*").alias("days"))


def exact_shapley(values: DataFrame, players: int) -> DataFrame:
    """Shapley values from the values of all coalitions (bit masks), by one self-join on the mask without a player."""
    weights = [factorial(s) * factorial(players - s - 1) / factorial(players) for s in range(players)]
    without = values.select(F.col("mask").alias("m_"), F.col("value").alias("v_"))
    rows = values.withColumn("player", F.explode(F.sequence(F.lit(0), F.lit(players - 1))))
    rows = rows.where("(mask & shiftleft(1, player)) > 0")
    rows = rows.withColumn("m_", F.expr("mask - shiftleft(1, player)")).join(without, "m_")
    scale = F.get(F.array(*[F.lit(w) for w in weights]), F.bit_count("m_"))
    return rows.groupBy("player").agg(F.sum(scale * (F.col("value") - F.col("v_"))).alias("shapley"))


def block_bootstrap(daily: DataFrame, x: str, replicates: int, block: int, seed: int) -> DataFrame:
    """Means of circular block resamples of a dated series.

    The series (one row a date) goes to every task as part of the plan; replicates are spread over tasks,
    each with its own seeded generator, so the result is the same on any cluster.
    """
    series = daily.groupBy().agg(F.array_sort(F.collect_list(F.struct("eob", x))).alias("s")).select(F.transform("s", lambda e: e[x]).alias("s"))
    spark = daily.sparkSession
    rows = spark.range(replicates).select(F.col("id").alias("replicate")).join(F.broadcast(series))

    def draw(frames):
        for frame in frames:
            out = []
            for i, s in zip(frame["replicate"], frame["s"], strict=True):
                r, s = np.random.default_rng([seed, i]), np.asarray(s, float)
                n = len(s)
                starts = r.integers(0, n, -(-n // block)) if n else np.empty(0, int)
                index = (starts[:, None] + np.arange(block)).ravel()[:n] % n if n else starts
                out.append(float(s[index].mean()) if n else None)
            yield pd.DataFrame({"replicate": frame["replicate"], "mean": out})

    return rows.mapInPandas(draw, "replicate long, mean double")


def benjamini_hochberg(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """Step-up adjusted p values of a small table of tests."""
    n = F.count("*").over(Window.partitionBy())
    raw = tests.withColumn("rank_", F.row_number().over(Window.orderBy(F.col(p), *[c for c in tests.columns if c != p])))
    raw = raw.withColumn("q_", F.col(p) * n / F.col("rank_"))
    low = F.min("q_").over(Window.orderBy(F.desc("rank_")).rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn("adjusted", F.least(low, F.lit(1.0))).drop("rank_", "q_")


def half_life(df: DataFrame, x: str = "close") -> DataFrame:
    """Half-life of each symbol's reversion: minus log 2 over the slope of changes on levels."""
    rows = df.withColumn("p_", lag(x)).withColumn("d_", F.col(x) - F.col("p_"))
    slope = F.regr_slope("d_", "p_")
    return rows.groupBy("symbol").agg(slope.alias("slope")).withColumn("half_life", F.when(F.col("slope") < 0, -F.log(F.lit(2.0)) / F.col("slope")))


def pair_spread(df: DataFrame, a: str, b: str) -> DataFrame:
    """Hedge ratio and R squared of one symbol's log price on another's."""
    y = df.where(F.col("symbol") == a).select("eob", F.log("close").alias("y"))
    x = df.where(F.col("symbol") == b).select("eob", F.log("close").alias("x"))
    return y.join(x, "eob").agg(F.regr_slope("y", "x").alias("hedge"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n"))


def component_snapshot(df: DataFrame, components: list[str], least: int) -> DataFrame:
    """Mean percent rank of the components that are there, if `least` of them are."""
    df = df.withColumns({f"p_{c}": average_rank(c) / F.count(c).over(by_date()) for c in components})
    there = F.filter(F.array(*[F.col(f"p_{c}") for c in components]), lambda v: v.isNotNull())
    mean = F.aggregate("v_", F.lit(0.0), lambda s, v: s + v) / F.size("v_")
    return df.withColumn("v_", there).withColumn("score", F.when(F.size("v_") >= least, mean)).withColumn("coverage", F.size("v_").cast("long")).drop("v_", *[f"p_{c}" for c in components])


# ---- summaries


def brinson_summary(df: DataFrame) -> DataFrame:
    """Mean and largest weights and summed effects of each category over all dates."""
    weights = df.groupBy("eob", "category").agg(F.sum("weight").alias("wp"), F.sum("benchmark").alias("wb"))
    both = brinson(df).join(weights, ["eob", "category"])
    return both.groupBy("category").agg(
        F.avg("wp").alias("avg_portfolio"), F.avg("wb").alias("avg_benchmark"), F.max("wp").alias("max_portfolio"), F.sum("allocation").alias("allocation"),
        F.sum("selection").alias("selection"), F.sum("interaction").alias("interaction"), F.sum(F.col("allocation") + F.col("selection") + F.col("interaction")).alias("total"), F.count_distinct("eob").alias("days"),
    )


def reconciled(pnl: DataFrame, daily: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Each date's profit summed over symbols beside the portfolio's (`from_portfolio`), and whether they agree."""
    rows = pnl.groupBy("eob").agg(F.sum("gross").alias("from_symbols")).join(daily, "eob")
    return rows.withColumn("agrees", F.abs(F.coalesce("from_symbols", F.lit(0.0)) - F.coalesce("from_portfolio", F.lit(0.0))) <= tolerance)


def action_summary(df: DataFrame) -> DataFrame:
    """Number, turnover, mean return to the next bar and profit of each kind of action."""
    moved = F.abs(F.col("weight") - F.col("before"))
    return actions(df).groupBy("action").agg(
        F.count("*").alias("actions"), F.sum(moved).alias("turnover"), F.avg(moved).alias("mean_turnover"), F.avg("ret").alias("mean_return"), F.sum(F.col("weight") * F.col("ret")).alias("pnl")
    )


def bucket_summary(buckets: DataFrame) -> DataFrame:
    """Means of the ranking buckets' returns, and how much and how often the top one is ahead of the others."""
    daily = buckets.groupBy("eob").agg(*[F.max(F.when(F.col("bucket") == b, F.col("mean_return"))).alias(b) for b in ("top", "next", "rest", "universe")])
    ahead = lambda b: F.avg(F.when(F.col("top").isNotNull() & F.col(b).isNotNull(), (F.col("top") > F.col(b)).cast("double")))
    others = ("next", "rest", "universe")
    return daily.agg(
        F.count("top").alias("dates"), *[F.avg(b).alias(f"{b}_mean") for b in ("top", *others)],
        *[F.avg(F.col("top") - F.col(b)).alias(f"over_{b}") for b in others], *[ahead(b).alias(f"wins_{b}") for b in others],
    )


def variant_metrics(rows: DataFrame) -> DataFrame:
    """Performance, turnover and cost of each variant; rows of variant, eob, gross, ret, turnover, cost."""
    before = Window.partitionBy("variant").orderBy("eob").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("e_", F.product(1 + F.col("ret")).over(before)).withColumn("dd_", 1 - F.col("e_") / F.max("e_").over(before))
    out = rows.groupBy("variant").agg(
        (F.max_by("e_", "eob") - 1).alias("total_return"), F.max("dd_").alias("max_drawdown"), (F.stddev_samp("ret") * 252**0.5).alias("v_"), F.count("*").alias("days"),
        F.sum("turnover").alias("turnover"), F.sum("cost").alias("cost"), (F.product(1 + F.col("gross")) - 1).alias("gross"),
    )
    out = out.withColumn("ann_return", F.pow(1 + F.col("total_return"), F.lit(252.0) / F.col("days")) - 1)
    return out.withColumn("sharpe", F.try_divide("ann_return", "v_"))


def _against(rows: DataFrame, base: str) -> DataFrame:
    """Each variant's figures beside those of the base variant (suffix _b); without it there are no rows."""
    all_ = variant_metrics(rows)
    own = all_.where(F.col("variant") == base)
    return all_.withColumn("one_", F.lit(1)).join(own.select(F.lit(1).alias("one_"), *[F.col(c).alias(f"{c}_b") for c in own.columns]), "one_")  # the base is one row


def counterfactuals(rows: DataFrame, base: str) -> DataFrame:
    """What the base variant has over each: return, drawdown, Sharpe ratio, turnover and cost."""
    d = lambda c: F.col(f"{c}_b") - F.col(c)
    return _against(rows, base).select(
        "variant", "ann_return", d("ann_return").alias("delta_return"), d("max_drawdown").alias("delta_drawdown"), d("sharpe").alias("delta_sharpe"), d("turnover").alias("delta_turnover"), d("cost").alias("delta_cost")
    )


def turnover_costs(rows: DataFrame, base: str) -> DataFrame:
    """For each variant without a player: what that player's trades cost, what they bring gross, and net."""
    both = _against(rows, base).where(F.col("variant") != base)
    saving, missed = F.col("cost") - F.col("cost_b"), F.col("gross") - F.col("gross_b")
    return both.select(
        "variant", (F.col("turnover_b") - F.col("turnover")).alias("turnover_edge"), saving.alias("cost_saving"), missed.alias("opportunity_cost"),
        (F.col("total_return_b") - F.col("total_return")).alias("net_edge"), (saving - missed).alias("net_value"),
    )


def episode_losers(pnl: DataFrame, top: int) -> DataFrame:
    """The symbols with the smallest profit between the peak and the trough of the deepest drawdown of the summed net profit."""
    daily = pnl.where("net IS NOT NULL").groupBy("eob").agg(F.sum("net").alias("ret"))
    whole = Window.orderBy("eob").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    e = daily.withColumn("e_", F.product(1 + F.col("ret")).over(whole)).withColumn("dd_", 1 - F.col("e_") / F.max("e_").over(whole))
    e = e.withColumn("peak", F.max(F.when(F.col("dd_") == 0, F.col("eob"))).over(whole))
    worst = e.agg(F.min_by(F.struct("peak", F.col("eob").alias("trough")), F.struct(F.negative("dd_"), "eob")).alias("w")).select("w.*")
    inside = pnl.join(F.broadcast(worst), (F.col("eob") > F.col("peak")) & (F.col("eob") <= F.col("trough")))  # one row
    return inside.groupBy("symbol").agg(F.sum("net").alias("pnl")).orderBy("pnl", "symbol").limit(top)


def interactions(values: DataFrame, players: int) -> DataFrame:
    """For each pair of players what the two are worth together beyond what each is worth alone; values: mask, value."""
    at = lambda mask: F.max(F.when(F.col("mask") == mask, F.col("value")))
    pairs = [(i, j) for i in range(players) for j in range(i + 1, players)]
    cells = [F.struct(F.lit(i).cast("long").alias("left_player"), F.lit(j).cast("long").alias("right_player"), (at((1 << i) | (1 << j)) - at(1 << i) - at(1 << j) + at(0)).alias("interaction")) for i, j in pairs]
    return values.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
