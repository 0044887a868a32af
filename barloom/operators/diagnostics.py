"""Checks of results: bootstrap tests of many candidates, votes that decide, exits against their baseline, unit roots, and universe flags."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import change, dates, lag, lead, series
from barloom.session import cut

#: A generator of block starts that any engine can repeat: x -> (x * STEP + SHIFT) mod MODULUS.
STEP, SHIFT, MODULUS = 1103515245, 12345, 2147483648


def block_start(replicate: Column, block: Column, n: Column, seed: int) -> Column:
    """A start from 0 to n - 1 that the replicate, the block and the seed decide."""
    x = (replicate * 1000003 + block * 7919 + seed) % MODULUS
    for _ in range(3):
        x = (x * STEP + SHIFT) % MODULUS
    return F.floor(x / float(MODULUS) * n)


def differentials(candidates: DataFrame, benchmark: str | None = None) -> DataFrame:
    """Rows (candidate, eob, ret) of the dates on which all candidates have a return, less the benchmark's if one is named."""
    rows = candidates.where(F.col("ret").isNotNull() & ~F.isnan("ret"))
    if benchmark is not None:
        own = rows.where(F.col("candidate") == benchmark).select("eob", F.col("ret").alias("b_"))
        rows = rows.where(F.col("candidate") != benchmark).join(own, "eob").withColumn("ret", F.col("ret") - F.col("b_")).drop("b_")
    whole = rows.select(F.count_distinct("candidate").alias("k_"))  # one row
    full = rows.groupBy("eob").agg(F.count("*").alias("c_")).join(F.broadcast(whole), F.col("c_") == F.col("k_")).select("eob")
    return rows.join(full, "eob", "left_semi")


def superiority_tests(candidates: DataFrame, benchmark: str | None = None, replicates: int = 500, block: int = 20, seed: int = 0) -> DataFrame:
    """Two bootstrap tests of whether the best of many candidates is better than none: the largest mean, and the largest studentised mean.

    Blocks are circular and never drawn out: a block's sum is the difference of two running sums, so a
    replicate costs its blocks and not its dates. The second test leaves out candidates far below 0.
    Returns test, best_candidate, p_value, statistic, bootstrap_mean, bootstrap_std, n_obs, n_candidates, block_size;
    no rows without two whole dates.
    """
    rows = differentials(candidates, benchmark)
    own = Window.partitionBy("candidate")
    rows = rows.withColumns({"n": F.count("*").over(own), "mean": F.avg("ret").over(own), "s_": F.stddev_samp("ret").over(own)}).where("n >= 2")
    running = F.sum(F.col("ret") - F.col("mean")).over(own.orderBy("eob").rowsBetween(Window.unboundedPreceding, 0))
    # everything below hangs on these narrow rows: they are worked out once
    rows = cut(rows.select("candidate", "ret", "n", "mean", "s_", F.row_number().over(own.orderBy("eob")).alias("t"), running.alias("sum")))
    sums = rows.select("candidate", "t", "sum")
    per = rows.groupBy("candidate").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("s_").alias("s_"))
    pooled = rows.agg(F.coalesce(F.nullif(F.stddev_samp("ret"), F.lit(0.0)), F.lit(1.0)).alias("pooled"))  # one row
    whole = Window.partitionBy()  # one row a candidate
    per = per.join(F.broadcast(pooled)).withColumn("std", F.coalesce(F.nullif("s_", F.lit(0.0)), F.col("pooled")))
    least = -F.sqrt(F.greatest(F.log(F.log(F.greatest("n", F.lit(3)))), F.lit(1.0)) / F.col("n")) * F.col("std")
    per = per.withColumns({"best": F.max("mean").over(whole), "in_": F.col("mean") >= least})
    per = per.withColumn("in_", F.when(F.max("in_").over(whole), F.col("in_")).otherwise(F.col("mean") == F.col("best")))
    per = cut(per.withColumn("score", F.sqrt("n") * F.col("mean") / F.col("std")))
    size = F.least(F.lit(block), F.col("n")).cast("long")
    head = per.agg(
        F.first("n").alias("n"), F.count("*").alias("n_candidates"), F.max("mean").alias("best_mean"), F.min_by("candidate", F.struct(-F.col("mean"), "candidate")).alias("best_candidate"),
        F.max(F.when(F.col("in_"), F.col("score"))).alias("best_score"),
    ).where("n IS NOT NULL").withColumn("size", size)
    draws = candidates.sparkSession.range(replicates).select(F.col("id").alias("replicate")).join(F.broadcast(head.select("n", "size")))
    draws = draws.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("size")) - 1)))
    draws = draws.withColumn("from", block_start(F.col("replicate"), F.col("k"), F.col("n"), seed))
    draws = draws.withColumn("to", F.col("from") + F.least("size", F.col("n") - F.col("k") * F.col("size")))  # the last block ends with the sample
    end = lambda t, sign: F.struct(t.cast("long").alias("t"), F.lit(sign).alias("sign"))
    ends = F.array(end(F.col("from"), -1), end(F.least("to", "n"), 1), end(F.greatest(F.col("to") - F.col("n"), F.lit(0)), 1))
    ends = draws.select("replicate", "n", F.explode(ends).alias("e")).select("replicate", "n", "e.*").where("t > 0")
    # equal ends of a replicate count together before they meet the running sums
    ends = ends.groupBy("replicate", "n", "t").agg(F.sum("sign").alias("sign"))
    means = ends.join(sums, "t").groupBy("replicate", "candidate").agg((F.sum(F.col("sign") * F.col("sum")) / F.first("n")).alias("m"))
    means = means.join(F.broadcast(per.select("candidate", "n", "std", "in_")), "candidate")
    most = means.groupBy("replicate").agg(F.max("m").alias("most"), F.max(F.when(F.col("in_"), F.sqrt("n") * F.col("m") / F.col("std"))).alias("most_score"))
    test = lambda name, statistic, x: F.struct(F.lit(name).alias("test"), F.col(statistic).alias("statistic"), F.col(x).alias("x"))
    tests = F.array(test("reality_check", "best_mean", "most"), test("spa", "best_score", "most_score"))
    long = most.join(F.broadcast(head)).select("best_candidate", "n", "n_candidates", "size", F.explode(tests).alias("e")).select("*", "e.*")
    reached = F.sum((F.col("x") >= F.col("statistic")).cast("long"))
    return long.groupBy("test").agg(
        F.first("best_candidate").alias("best_candidate"), ((reached + 1) / (F.count("x") + 1)).alias("p_value"), F.first("statistic").alias("statistic"), F.avg("x").alias("bootstrap_mean"),
        F.stddev_samp("x").alias("bootstrap_std"), F.first("n").alias("n_obs"), F.first("n_candidates").alias("n_candidates"), F.first("size").alias("block_size"),
    )


def vote_criticality(df: DataFrame, votes: list[str], threshold: float, selected: Column | None = None, held: Column | None = None) -> DataFrame:
    """For each row and vote: the count with and without it, and whether an entry or a holding hangs on it.

    A row is eligible from `threshold` votes on; missing votes count 0 and are skipped. Without `selected` all
    eligible rows are entries, without `held` none is a holding.
    """
    total = sum((F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in votes), F.lit(0.0))
    valid = sum((F.col(v).isNotNull().cast("long") for v in votes), F.lit(0))
    cells = F.array(*[F.struct(F.lit(v).alias("player"), F.col(v).cast("double").alias("vote_value")) for v in votes])
    rows = df.select("symbol", "eob", total.alias("vote_count_full"), valid.alias("valid_player_count"), (total >= threshold if selected is None else selected).alias("s_"),
                     (F.lit(False) if held is None else held).alias("h_"), F.explode(cells).alias("x")).select("*", "x.*")
    without = F.col("vote_count_full") - F.coalesce("vote_value", F.lit(0.0))
    critical = (F.col("vote_count_full") >= threshold) & (without < threshold)
    flag = lambda x: F.coalesce(x, F.lit(False)) & critical
    return rows.select(
        "symbol", "eob", "player", "vote_value", "vote_count_full", "valid_player_count", without.alias("vote_count_without_vote"), (F.col("vote_count_full") >= threshold).alias("eligible_full"),
        (without >= threshold).alias("eligible_without_vote"), flag(F.col("s_")).alias("entry_critical"), flag(F.col("h_")).alias("hold_critical"),
        F.try_divide("vote_value", F.nullif("vote_count_full", F.lit(0.0))).alias("score_share"), F.when(F.col("vote_value").isNotNull(), "ok").otherwise("skipped").alias("status"),
    )


def summarize_votes(edges: DataFrame) -> DataFrame:
    """Each vote's rows, coverage, and how often an entry or a holding hung on it."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return edges.groupBy("player").agg(
        F.count("*").alias("rows"), F.avg((F.col("status") == "ok").cast("double")).alias("coverage"), F.sum(F.col("entry_critical").cast("long")).alias("entry_edges"),
        F.sum(F.col("hold_critical").cast("long")).alias("hold_edges"), share("entry_critical").alias("entry_edge_rate"), F.avg("score_share").alias("mean_score_share"),
    )


# ---- exits: rows of symbol, eob, close, base and variant weights


def triggered(base: str = "base", variant: str = "variant") -> Column:
    """Whether the baseline holds what the variant let go."""
    return (F.col(base) > 0) & (F.coalesce(F.col(variant), F.lit(0.0)) == 0)


def trigger_stats(df: DataFrame, low: float = 0.6) -> DataFrame:
    """One row: hits, their share of the baseline's holdings, and the variant's exposure over the dates."""
    daily = df.groupBy("eob").agg(
        F.sum(triggered().cast("long")).alias("hits"), F.sum((F.col("base") > 0).cast("long")).alias("held"), F.sum(F.coalesce("variant", F.lit(0.0))).alias("exposure")
    )
    return daily.agg(
        F.sum("hits").alias("hit_count"), F.coalesce(F.try_divide(F.sum("hits"), F.sum("held")), F.lit(0.0)).alias("hit_rate"), F.avg("exposure").alias("exposure_mean"),
        F.stddev_samp("exposure").alias("exposure_std"), F.avg((F.col("exposure") < low).cast("double")).alias("low_exposure_days_pct"),
    )


def trigger_returns(df: DataFrame, horizons: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """For each horizon the sums of the next returns after triggers: mean, deciles, chances of large moves, and their number.

    One sort by symbol serves all horizons; a missing return counts 0.
    """
    rows = df.withColumn("r_", change())
    ahead = {h: F.coalesce(F.sum("r_").over(series().rowsBetween(1, h)), F.lit(0.0)) for h in horizons}
    cells = F.array(*[F.struct(F.lit(h).cast("long").alias("horizon"), x.alias("x")) for h, x in ahead.items()])
    long = rows.select(triggered().alias("t_"), cells.alias("c")).where("t_").select(F.explode("c").alias("e")).select("e.*")
    part = lambda test: F.avg(test.cast("double"))
    return long.groupBy("horizon").agg(
        F.avg("x").alias("mean"), *[F.percentile("x", q / 100).alias(f"p{q}") for q in (10, 50, 90)], part(F.col("x") < -0.02).alias("big_loss_prob_2pct"),
        part(F.col("x") < -0.04).alias("big_loss_prob_4pct"), part(F.col("x") > 0.02).alias("big_gain_prob_2pct"), F.count("*").alias("count"),
    )


# ---- universe flags


def next_open(flag: Column) -> Column:
    """The flag of a symbol's next bar, by which today's signal would trade; the last bar keeps its own."""
    return F.coalesce(lead(flag), flag)


def universe_flags(df: DataFrame, fresh: int = 120, limit: float = 0.1) -> DataFrame:
    """newly_listed (inside the first `fresh` bars), suspended (no volume) and limit_up_open (opens at the limit or above), as of the next bar."""
    age = F.row_number().over(series())
    rows = df.withColumns({"new_": age <= fresh, "stuck_": F.coalesce(F.col("volume"), F.lit(0.0)) == 0, "up_": F.coalesce(F.col("open") >= lag("close") * (1 + limit), F.lit(False))})
    return rows.select("symbol", "eob", *[next_open(F.col(a)).alias(b) for a, b in (("new_", "newly_listed"), ("stuck_", "suspended"), ("up_", "limit_up_open"))])


# ---- shapes of returns


#: A rational approximation of the normal quantile (relative error below 2e-9), its middle part and its ends.
PPF_MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
PPF_END = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
PPF_LOW = 0.02425


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of a probability strictly between 0 and 1."""

    def ratio_of(x: Column, parts: tuple[tuple[float, ...], ...]) -> Column:
        above, below = (F.lit(part[0]) for part in parts)
        for c in parts[0][1:]:
            above = above * x + c
        for c in parts[1][1:]:
            below = below * x + c
        return above / below

    middle, end = p - 0.5, lambda q: ratio_of(F.sqrt(-2 * F.log(q)), PPF_END)
    return F.when(p < PPF_LOW, end(p)).when(p > 1 - PPF_LOW, -end(1 - p)).otherwise(middle * ratio_of(middle * middle, PPF_MIDDLE))


def return_shapes(df: DataFrame, lags: tuple[int, ...] = tuple(range(1, 35))) -> DataFrame:
    """For each symbol and lag the log returns' n, excess kurtosis, skewness, and their root mean square distance from normal quantiles.

    One sort by symbol makes the returns of all lags; each (symbol, lag) is ranked apart. Null where returns
    do not vary.
    """
    price = F.log(F.when(F.col("close") > 0, F.col("close")))
    rows = df.select("symbol", "eob", price.alias("y"))
    cells = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), (F.col("y") - lag("y", k)).alias("r")) for k in lags])
    long = rows.select("symbol", "eob", cells.alias("c")).select("symbol", "eob", F.explode("c").alias("e")).select("symbol", "eob", "e.*").where("r IS NOT NULL")
    own = Window.partitionBy("symbol", "lag")
    placed = long.withColumns({"n_": F.count("*").over(own), "t_": F.row_number().over(own.orderBy("r", "eob")), "z_": F.try_divide(F.col("r") - F.avg("r").over(own), F.nullif(F.stddev_samp("r").over(own), F.lit(0.0)))})
    away = normal_quantile((F.col("t_") - 0.5) / F.col("n_")) - F.col("z_")
    return placed.groupBy("symbol", "lag").agg(
        F.count("*").alias("n"), F.kurtosis("z_").alias("kurtosis"), F.skewness("z_").alias("skewness"), F.sqrt(F.avg(away * away)).alias("qq_deviation")
    )


# ---- unit roots


def detrended(df: DataFrame, x: str = "close", trend: bool = True) -> DataFrame:
    """symbol, t (from 1), n and the residual `e` of x on a constant, and on time if `trend`; missing values are left out."""
    own = Window.partitionBy("symbol")
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(x)).select("symbol", "eob", F.col(x).cast("double").alias("x_"))
    rows = rows.withColumns({"t": F.row_number().over(own.orderBy("eob")), "n": F.count("*").over(own)})
    slope = F.coalesce(F.try_divide(F.covar_pop("x_", "t").over(own), F.var_pop("t").over(own)), F.lit(0.0)) if trend else F.lit(0.0)
    rows = rows.withColumn("b_", slope)
    return rows.select("symbol", "t", "n", (F.col("x_") - F.avg("x_").over(own) - F.col("b_") * (F.col("t") - F.avg("t").over(own))).alias("e"))


#: Fixed values of the test's table: levels of p and the statistics that belong to them, around a trend and around a constant.
KPSS_P = (0.10, 0.05, 0.025, 0.01)
KPSS_TREND, KPSS_LEVEL = (0.119, 0.146, 0.176, 0.216), (0.347, 0.463, 0.574, 0.739)


def interpolated(x: Column, at: tuple[float, ...], values: tuple[float, ...]) -> Column:
    """Straight lines between the given points, level beyond them."""
    out = F.when(x <= at[0], values[0])
    for a, b, u, v in zip(at, at[1:], values, values[1:], strict=False):
        out = out.when(x <= b, u + (x - a) / (b - a) * (v - u))
    return out.otherwise(values[-1])


def kpss(df: DataFrame, x: str = "close", trend: bool = True) -> DataFrame:
    """Test of stationarity of each symbol: symbol, n, lags, statistic, p_value (0.01 to 0.1); null where the residuals are all 0.

    The lags come from the data (a first pass over n ** (2/9) of them). A Bartlett-weighted variance of L lags
    is the mean square of moving sums of L residuals, and these are differences of running sums: each pass
    is one equi-join of a symbol's rows with itself, whatever the number of lags.
    """
    own = Window.partitionBy("symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = detrended(df, x, trend).withColumn("s", F.sum("e").over(own))
    per = rows.groupBy("symbol", "n").agg(F.sum(F.col("e") * F.col("e")).alias("g0"), F.sum(F.col("s") * F.col("s")).alias("eta"))

    def weighted(lengths: DataFrame) -> DataFrame:
        """symbol, length -> b: the sum of products at all distances below `length`, weighted by 1 - distance / length."""
        here = rows.join(lengths.select("symbol", "length"), "symbol")
        # a moving sum ends at any of 1 .. n + length - 1; beyond n the running sum stands at its last value, which is 0 as residuals sum to 0
        ends = here.select("symbol", "length", F.explode(F.array(F.struct(F.col("t").alias("at"), F.col("s").alias("v")), F.struct((F.col("t") + F.col("length")).alias("at"), (-F.col("s")).alias("v")))).alias("p"))
        sums = ends.groupBy("symbol", "length", "p.at").agg(F.sum("p.v").alias("m"))
        return sums.groupBy("symbol", "length").agg((F.sum(F.col("m") * F.col("m")) / F.first("length")).alias("b"))

    first = per.withColumn("c", F.floor(F.pow(F.col("n").cast("double"), F.lit(2 / 9))).cast("int"))
    b = weighted(first.select("symbol", F.explode(F.array("c", F.col("c") + 1)).alias("length")))
    both = first.join(b, "symbol").groupBy("symbol", "n", "g0", "eta", "c").agg(F.sum(F.when(F.col("length") == F.col("c"), F.col("b"))).alias("b0"), F.sum(F.when(F.col("length") == F.col("c") + 1, F.col("b"))).alias("b1"))
    flat = (F.col("c") + 1) * F.col("b1") - F.col("c") * F.col("b0")  # all products at distances up to c, on both sides
    sloped = (F.col("c") + 1) * (flat - F.col("b1"))  # the same, each times its distance
    ratio = F.try_divide(sloped, flat)
    auto = F.floor(1.1447 * F.pow(ratio * ratio, F.lit(1 / 3)) * F.pow(F.col("n").cast("double"), F.lit(1 / 3)))
    chosen = both.withColumn("lags", F.least(F.coalesce(auto, F.lit(0)), F.col("n") - 1).cast("int"))
    last = weighted(chosen.select("symbol", (F.col("lags") + 1).alias("length"))).select("symbol", "b")
    out = chosen.join(last, "symbol").withColumn("statistic", F.try_divide("eta", F.col("n") * F.when(F.col("g0") > 1e-18, F.col("b"))))
    at = KPSS_TREND if trend else KPSS_LEVEL
    return out.select("symbol", F.col("n").alias("n_obs"), "lags", "statistic", F.when(F.col("statistic").isNotNull(), interpolated(F.col("statistic"), at, KPSS_P)).alias("p_value"))


#: The p value of a unit-root statistic around a constant is the normal distribution of a polynomial in it (low side, high
#: side, where they meet, and the ends), and the critical values at 1, 5 and 10 % are polynomials in 1 / observations.
ADF_LOW, ADF_HIGH = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
ADF_MEET, ADF_ENDS = -1.61, (-18.83, 2.74)
ADF_CRITICAL = ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.04), (-2.56677, -1.5384, -2.809, 0.0))


def adf_p_value(statistic: float) -> float:
    if not ADF_ENDS[0] <= statistic <= ADF_ENDS[1]:
        return float(statistic > ADF_ENDS[1])
    terms = ADF_LOW if statistic <= ADF_MEET else ADF_HIGH
    return 0.5 * math.erfc(-sum(c * statistic**i for i, c in enumerate(terms)) / math.sqrt(2))


def most_lags(n: int) -> int:
    """The lags that n values allow: 12 (n / 100) ** (1/4), and half of the values less two at most."""
    return min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))


class _Moments:
    """Sums of products of (1, level, lagged changes, change) of one series that comes in pieces; the first rows are kept apart."""

    def __init__(self, n: int):
        self.n, self.lags = n, most_lags(n)
        self.products, self.head, self.tail, self.base = 0.0, np.empty(0), np.empty(0), None

    def rows(self, x: np.ndarray, lags: int) -> np.ndarray:
        """One row for each value with `lags` changes before its own."""
        d = np.diff(x)
        if len(d) <= lags:
            return np.empty((0, lags + 3))
        turns = np.lib.stride_tricks.sliding_window_view(d, lags + 1)[:, ::-1]  # the own change, then those before
        return np.column_stack([np.ones(len(turns)), x[lags : len(x) - 1], turns[:, 1:], turns[:, 0]])

    def add(self, x: np.ndarray) -> None:
        if self.base is None:
            self.base = float(x[0])
        x = np.concatenate([self.tail, x - self.base])  # the level's zero does not matter beside a constant
        if len(self.head) < 2 * self.lags + 2:
            self.head = np.concatenate([self.head, x[len(self.tail) :]])[: 2 * self.lags + 2]
        z = self.rows(x, self.lags)
        self.products = self.products + z.T @ z
        self.tail = x[-(self.lags + 1) :]

    def fit(self, products: np.ndarray, lags: int) -> tuple[float, float, float]:
        """Residual square sum, statistic of the level and number of rows of the regression on the first `lags` changes."""
        own = [*range(lags + 2)]
        a, b, yy = products[np.ix_(own, own)], products[own, -1], products[-1, -1]
        inverse = np.linalg.pinv(a, hermitian=True)
        beta = inverse @ b
        left, rows = max(float(yy - beta @ b), 0.0), float(products[0, 0])
        spread = math.sqrt(left / max(rows - lags - 2, 1) * max(inverse[1, 1], 0.0))
        return left, float(beta[1]) / spread if spread > 0 else math.nan, rows

    def result(self) -> tuple[int, float] | None:
        """Lags with the least information criterion, and the statistic over all rows they allow."""
        if self.lags < 0 or np.ndim(self.products) == 0 or self.products[0, 0] <= self.lags + 2 or self.products[-1, -1] <= 0:
            return None
        scores = []
        for k in range(self.lags + 1):
            left, _, rows = self.fit(self.products, k)
            scores.append(rows * math.log(max(left / rows, 1e-300)) + 2 * (k + 2))
        best = int(np.argmin(scores))
        keep = [*range(best + 2), self.lags + 2]
        first = self.rows(self.head[: self.lags + 1], best)  # rows that the longest lags could not use
        _, statistic, _ = self.fit(self.products[np.ix_(keep, keep)] + first.T @ first, best)
        return None if math.isnan(statistic) else (best, statistic)


def adf(df: DataFrame, x: str = "close") -> DataFrame:
    """Unit-root test of each symbol around a constant, lags by the information criterion of Akaike.

    Returns symbol, n_obs, lags, statistic, p_value, critical_1pct, critical_5pct, critical_10pct; null results
    for a constant series or one too short. Missing values are left out. A symbol's sorted rows stream through
    one task that holds a batch and the sums of products of at most a few dozen columns.
    """

    def row(symbol: str, m: _Moments) -> tuple:
        got = m.result()
        if got is None:
            return symbol, m.n, None, None, None, None, None, None
        rows = m.n - 1 - got[0]
        return symbol, m.n, *got, adf_p_value(got[1]), *[sum(c / rows**i for i, c in enumerate(level)) for level in ADF_CRITICAL]

    schema = "symbol string, n_obs long, lags int, statistic double, p_value double, critical_1pct double, critical_5pct double, critical_10pct double"
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.float64()] * 5]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values, done = batch.column("x").to_numpy(), []
            own, sizes = batch.column("symbol").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if state is None or own[a] != symbol:
                    if state is not None:
                        done.append(row(symbol, state))
                    symbol, state = own[a], _Moments(int(sizes[a]))
                if state.lags >= 0:
                    state.add(values[a:b])
            if done:
                yield packed(done)
        if state is not None:
            yield packed([row(symbol, state)])

    rows = df.where(F.col(x).isNotNull() & ~F.isnan(x) & F.col("symbol").isNotNull()).select("symbol", "eob", F.col(x).cast("double").alias("x"))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    return rows.repartition("symbol").sortWithinPartitions("symbol", "eob").select("symbol", "x", "n").mapInArrow(run, schema)


def cointegration(pairs: DataFrame, significance: float = 0.05) -> DataFrame:
    """Two-step test of each pair (rows of symbol, eob, y, x, the pair's name as symbol): y on x, then a unit-root test of what is left.

    Returns the pair's alpha, beta, r_squared and the columns of `adf`, with is_cointegrated; pairs under 20 whole rows have no test.
    """
    own = Window.partitionBy("symbol")
    rows = pairs.where(F.col("y").isNotNull() & F.col("x").isNotNull()).withColumn("m_", F.count("*").over(own)).where("m_ >= 20")
    line = rows.groupBy("symbol").agg(F.regr_intercept("y", "x").alias("alpha"), F.regr_slope("y", "x").alias("beta"), F.regr_r2("y", "x").alias("r_squared"))
    beta = F.coalesce(F.try_divide(F.covar_pop("y", "x").over(own), F.var_pop("x").over(own)), F.lit(0.0))
    left = rows.withColumn("b_", beta).withColumn("left_", F.col("y") - F.avg("y").over(own) - F.col("b_") * (F.col("x") - F.avg("x").over(own)))
    return line.join(adf(left, "left_"), "symbol").withColumn("is_cointegrated", F.col("p_value") < significance)
