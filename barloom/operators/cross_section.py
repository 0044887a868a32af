"""Cross-sections: cleaning, ranks, information coefficients, quantile groups, selection, labels.

Panels are long: symbol, eob and value columns. Windows over a date hold one date's symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import average_rank, by_date, col, correlation, first_rank, lead, percent_rank, population_z, ratio


def clip_mad(df: DataFrame, x: str, n: float, by: tuple[str, ...] = ("eob",), out: str = "value") -> DataFrame:
    """x held within n median absolute deviations of its group's median."""
    group = Window.partitionBy(*by)
    df = df.withColumn("m_", F.percentile(x, F.lit(0.5)).over(group))
    df = df.withColumn("d_", F.percentile(F.abs(F.col(x) - F.col("m_")), F.lit(0.5)).over(group) * n)
    held = F.when(F.col(x).isNotNull(), F.greatest(F.least(F.col(x), F.col("m_") + F.col("d_")), F.col("m_") - F.col("d_")))
    return df.withColumn(out, held).drop("m_", "d_")


def clip_std(df: DataFrame, x: str, n: float = 3.0, by: tuple[str, ...] = ("eob",), out: str = "value") -> DataFrame:
    """x held within n sample deviations of its group's mean."""
    group = Window.partitionBy(*by)
    m, s = F.avg(x).over(group), F.stddev_samp(x).over(group) * n
    return df.withColumn(out, F.when(F.col(x).isNotNull(), F.greatest(F.least(F.col(x), m + s), m - s)))


def clip_percentile(df: DataFrame, x: str, left: float = 0.025, right: float = 0.975, by: tuple[str, ...] = ("eob",), out: str = "value") -> DataFrame:
    """x held between two interpolated percentiles of its group."""
    group = Window.partitionBy(*by)
    low, high = F.percentile(x, F.lit(left)).over(group), F.percentile(x, F.lit(right)).over(group)
    return df.withColumn(out, F.when(F.col(x).isNotNull(), F.greatest(F.least(F.col(x), high), low)))


def forward_return(price: str = "close", horizon: int = 1, lag: int = 0, signal_lag: int = 1) -> Column:
    """Return from the price at which a signal can be executed to `horizon` bars later."""
    start = signal_lag + lag
    return ratio(lead(price, start + horizon), lead(price, start)) - 1


def rank_ic(df: DataFrame, factor: str, target: str, least: int = 5, by: tuple[str, ...] = ("eob",)) -> DataFrame:
    """Spearman correlation of factor and target in each group with `least` whole pairs or more."""
    pairs = df.where(F.col(factor).isNotNull() & F.col(target).isNotNull())
    ranked = pairs.select(*by, average_rank(factor, by).alias("a_"), average_rank(target, by).alias("b_"))
    out = ranked.groupBy(*by).agg(correlation("a_", "b_").alias("ic"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


def information_surface(df: DataFrame, factors: list[str], horizons: list[int], lags: list[int], least: int = 5) -> DataFrame:
    """Mean, deviation and ratio of daily rank ICs for each factor, horizon and lag, in one pass.

    The grid is unfolded on the rows (one array of all cells), so the panel is shuffled by symbol once
    and by (cell, date) once, whatever the grid's size.
    """
    returns = {f"f_{h}_{g}": forward_return("close", h, g) for h in horizons for g in lags}
    wide = df.withColumns(returns)
    cells = F.array(*[
        F.struct(F.lit(f).alias("factor"), F.lit(h).alias("horizon"), F.lit(g).alias("lag"), F.col(f).alias("x"), F.col(f"f_{h}_{g}").alias("y"))
        for f in factors for h in horizons for g in lags
    ])
    long = wide.select("eob", F.explode(cells).alias("c")).select("eob", "c.*")
    daily = rank_ic(long, "x", "y", least, ("factor", "horizon", "lag", "eob"))
    return summarize_ic(daily, ("factor", "horizon", "lag"))


def summarize_ic(daily: DataFrame, by: tuple[str, ...]) -> DataFrame:
    s = F.stddev_samp("ic")
    return daily.groupBy(*by).agg(
        F.avg("ic").alias("ic_mean"), s.alias("ic_std"), F.try_divide(F.avg("ic"), s).alias("ic_ir"),
        F.avg((F.col("ic") > 1e-9).cast("double")).alias("positive"), F.count("ic").alias("n"),
    )


def newey_west(daily: DataFrame, x: str, lag: int) -> DataFrame:
    """Mean of a dated series and its t statistic with Bartlett weights up to `lag`.

    The series is one row a date, so its window is small whatever the panel.
    """
    whole = Window.orderBy("eob")
    d = daily.select("eob", (F.col(x) - F.avg(x).over(Window.partitionBy())).alias("d"), F.avg(x).over(Window.partitionBy()).alias("m"))
    d = d.withColumns({f"g{k}": F.col("d") * F.lag("d", k).over(whole) for k in range(1, lag + 1)})
    n = F.count("*")
    variance = F.sum(F.col("d") * F.col("d")) / n
    for k in range(1, lag + 1):
        variance = variance + 2 * (1 - k / (lag + 1)) * F.coalesce(F.sum(f"g{k}"), F.lit(0.0)) / n
    return d.agg(F.max("m").alias("mean"), n.alias("n"), F.sqrt(variance / n).alias("se")).withColumn("t", F.try_divide("mean", "se"))


def quantile_groups(df: DataFrame, x: str, groups: int, by: tuple[str, ...] = ("eob",), out: str = "bucket") -> DataFrame:
    """Equal-count groups from the lowest value; what is left over goes to the last group; ties go by symbol."""
    rows = df.where(F.col(x).isNotNull())
    order = Window.partitionBy(*by).orderBy(F.col(x).asc(), F.col("symbol"))
    size = F.floor(F.count("*").over(Window.partitionBy(*by)) / groups)
    place = F.floor((F.row_number().over(order) - 1) / F.greatest(size, F.lit(1))) + 1
    return rows.withColumn(out, F.least(place, F.lit(groups)).cast("int"))


def group_returns(df: DataFrame, x: str, target: str, groups: int) -> DataFrame:
    """Mean target of each quantile group and date."""
    return quantile_groups(df.where(F.col(target).isNotNull()), x, groups).groupBy("eob", "bucket").agg(F.avg(target).alias("mean_return"), F.count("*").alias("n"))


def group_turnover(df: DataFrame, x: str, groups: int) -> DataFrame:
    """Share of each group's members that left or came since the date before, over the earlier number."""
    sets = quantile_groups(df, x, groups).groupBy("eob", "bucket").agg(F.collect_set("symbol").alias("now"))
    before = F.lag("now").over(Window.partitionBy("bucket").orderBy("eob"))
    moved = F.size(F.array_except("now", "was")) + F.size(F.array_except("was", "now"))
    return sets.withColumn("was", before).where("was IS NOT NULL").select("eob", "bucket", (moved / F.size("was")).alias("turnover"))


def factor_correlation(df: DataFrame, factors: list[str]) -> DataFrame:
    """Mean over dates of the Spearman correlation of each pair of factors."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    cells = F.array(*[F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
    long = df.select("eob", F.explode(cells).alias("c")).select("eob", "c.*")
    return rank_ic(long, "x", "y", 2, ("factor_a", "factor_b", "eob")).groupBy("factor_a", "factor_b").agg(F.avg("ic").alias("correlation"), F.count("ic").alias("n"))


def rank_autocorrelation(df: DataFrame, x: str, periods: list[int]) -> DataFrame:
    """Mean over dates of the correlation of a factor's ranks with its ranks `period` bars before."""
    ranked = df.where(F.col(x).isNotNull()).select("symbol", "eob", average_rank(x).alias("r"))
    series = Window.partitionBy("symbol").orderBy("eob")
    cells = F.array(*[F.struct(F.lit(p).alias("period"), F.col("r").alias("r"), F.lag("r", p).over(series).alias("q")) for p in periods])
    long = ranked.withColumn("c", cells).select("eob", F.explode("c").alias("c")).select("eob", "c.*").where("q IS NOT NULL")
    return long.groupBy("period", "eob").agg(correlation("r", "q").alias("k")).groupBy("period").agg(F.avg("k").alias("autocorrelation"), F.count("k").alias("n"))


def top_jaccard(df: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """Jaccard similarity of two factors' top n symbols on each date."""
    both = df.withColumns({"x_": first_rank(a), "y_": first_rank(b)})
    sets = both.groupBy("eob").agg(F.collect_set(F.when((F.col("x_") <= n) & col(a).isNotNull(), F.col("symbol"))).alias("p"), F.collect_set(F.when((F.col("y_") <= n) & col(b).isNotNull(), F.col("symbol"))).alias("q"))
    return sets.select("eob", F.try_divide(F.size(F.array_intersect("p", "q")).cast("double"), F.size(F.array_union("p", "q"))).alias("jaccard"))


def combined_score(df: DataFrame, directions: dict[str, int], weights: dict[str, float] | None = None, method: str = "rank") -> DataFrame:
    """Weighted mean of oriented, normalised factors; factors that are missing count neither above nor below."""
    if any(d not in (-1, 1) for d in directions.values()):
        raise ValueError("directions are -1 or 1")
    weights = weights or dict.fromkeys(directions, 1.0)
    df = df.withColumns({f"o_{f}": F.col(f) * d for f, d in directions.items()})
    norm = percent_rank if method == "rank" else population_z
    df = df.withColumns({f"n_{f}": norm(f"o_{f}") for f in directions})
    total = sum((F.coalesce(F.col(f"n_{f}") * w, F.lit(0.0)) for f, w in weights.items()), F.lit(0.0))
    there = sum((F.when(F.col(f"n_{f}").isNotNull(), w).otherwise(0.0) for f, w in weights.items()), F.lit(0.0))
    return df.withColumn("score", F.try_divide(total, there)).drop(*[f"{p}_{f}" for p in "on" for f in directions])


def top_n(df: DataFrame, score: str, n: int, gross: float = 1.0) -> DataFrame:
    """Equal weights of each date's n best scores; ties go by symbol."""
    kept = df.where(F.col(score).isNotNull()).withColumn("place_", first_rank(score)).where(F.col("place_") <= n)
    return kept.withColumn("weight", F.lit(gross) / F.count("*").over(by_date())).drop("place_")


def partial_rank_ic(df: DataFrame, factor: str, forward: str, control: str, least: int = 5) -> DataFrame:
    """Daily rank correlation of a factor with the return ahead beyond what both share with a control: eob, ic, partial_ic, n.

    All three come from one pass over a date's ranks; partial_ic is null where the control explains a side wholly.
    """
    names = (factor, forward, control)
    rows = df.dropna(subset=list(names))
    rows = rows.select("eob", *[average_rank(c).alias(f"k_{i}") for i, c in enumerate(names)])
    pair = lambda i, j: correlation(f"k_{i}", f"k_{j}")
    daily = rows.groupBy("eob").agg(pair(0, 1).alias("ic"), pair(0, 2).alias("a_"), pair(1, 2).alias("b_"), F.count("*").alias("n")).where(F.col("n") >= least)
    left = (1 - F.col("a_") * F.col("a_")) * (1 - F.col("b_") * F.col("b_"))
    return daily.select("eob", "ic", ((F.col("ic") - F.col("a_") * F.col("b_")) / F.sqrt(F.when(left > 1e-9, left))).alias("partial_ic"), "n")


def votes(df: DataFrame, factors: list[str], share: float) -> DataFrame:
    """For each symbol and date the number of factors that rank it in their best `share`."""
    picks = []
    for f in factors:
        most = F.greatest(F.floor(F.count(F.col(f)).over(by_date()) * share), F.lit(1))
        picks.append(F.coalesce((average_rank(f, descending=True) <= most).cast("long"), F.lit(0)))
    return df.withColumn("votes", sum(picks, F.lit(0)))


def return_label(horizon: int, up: float, down: float, price: str = "close") -> Column:
    """1, -1 or 0 for a forward return above `up`, below minus `down`, or between; 0 at the end."""
    r = ratio(lead(price, horizon), F.col(price)) - 1
    return F.when(r > up, 1).when(r < -abs(down), -1).otherwise(0)


def triple_barrier(df: DataFrame, up: float, down: float, bars: int, price: str = "close") -> DataFrame:
    """1 or -1 for the barrier that the next `bars` prices touch first, else 0; 0 where fewer prices follow."""
    ahead = F.collect_list(price).over(Window.partitionBy("symbol").orderBy("eob").rowsBetween(1, bars))
    touch = F.filter(F.transform("ahead_", lambda p: F.when(p >= F.col(price) * (1 + up), 1).when(p <= F.col(price) * (1 - down), -1)), lambda t: t.isNotNull())
    return df.withColumn("ahead_", ahead).withColumn("label", F.when(F.size("ahead_") < bars, 0).otherwise(F.coalesce(F.get(touch, F.lit(0)), F.lit(0)))).drop("ahead_")


def rank_labels(df: DataFrame, horizon: int) -> DataFrame:
    """Percent rank of the forward return on each date; rows without one go."""
    r = df.withColumn("r_", ratio(lead("close", horizon), F.col("close")) - 1).where("r_ IS NOT NULL")
    return r.withColumn("label", percent_rank("r_")).drop("r_")
