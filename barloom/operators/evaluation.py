"""What a candidate factor adds to a pool, whether it holds up in parts of its sample, and two books on one panel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import average_rank, correlation, dates, lag, lead, ratio
from barloom.operators.cross_section import rank_ic
from barloom.operators.portfolio import executed
from barloom.session import cut

POOLED = ("residual_ic", "conditional_corr", "r2_before", "r2_after")


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at their mean."""
    _, where, times = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(times)
    return ((last - times + 1 + last) / 2.0)[where]


def residual(y: np.ndarray, design: np.ndarray) -> np.ndarray | None:
    """What least squares leave of y; None if the columns do not all count or there are no more rows than columns."""
    if len(y) <= design.shape[1]:
        return None
    beta, _, rank, _ = np.linalg.lstsq(design, y, rcond=None)
    return y - design @ beta if rank == design.shape[1] else None


def correlated(a: np.ndarray | None, b: np.ndarray | None) -> float | None:
    if a is None or b is None or a.std() < 1e-12 or b.std() < 1e-12:
        return None
    return float(np.corrcoef(a, b)[0, 1])


def pooled_row(candidate: np.ndarray, pool: np.ndarray, forward: np.ndarray) -> tuple[float | None, ...]:
    """Of one date: the rank IC of what the pool leaves of the candidate, the rank correlation beyond the pool, and r2 without and with the candidate."""
    ones = np.ones((len(forward), 1))
    design, wider = np.column_stack([ones, pool]), np.column_stack([ones, pool, candidate])
    rest = residual(candidate, design)
    ic = correlated(average_ranks(rest), average_ranks(forward)) if rest is not None and rest.std() >= 1e-12 else None
    ranks = np.column_stack([ones, *map(average_ranks, pool.T)])
    beyond = correlated(residual(average_ranks(forward), ranks), residual(average_ranks(candidate), ranks)) if len(forward) > ranks.shape[1] + 1 else None
    spread = float(((forward - forward.mean()) ** 2).sum())
    share = lambda left: None if left is None or spread <= 0 else 1 - float((left**2).sum()) / spread
    before, after = share(residual(forward, design)), share(residual(forward, wider))
    if before is not None and after is None and rest is not None and rest.std() < 1e-10:
        after = before  # the pool holds the candidate already
    return (ic, beyond, before, after) if before is not None and after is not None else (ic, beyond, None, None)


def pool_by_date(df: DataFrame, candidate: str, pool: list[str], forward: str, least: int = 5) -> DataFrame:
    """`pooled_row` of every date with `least` whole rows: eob, n and the columns of POOLED. One date is one cross-section."""

    def judged(part: pa.Table) -> pa.Table:
        part = part.sort_by("symbol")
        x, z, y = part.column(candidate).to_numpy(), np.column_stack([part.column(c).to_numpy() for c in pool]), part.column(forward).to_numpy()
        out = pooled_row(x, z, y) if len(y) >= least else (None,) * len(POOLED)
        return pa.table({"eob": part.column("eob").slice(0, 1), "n": pa.array([len(y)], pa.int64())} | {c: pa.array([v], pa.float64()) for c, v in zip(POOLED, out, strict=True)})

    rows = df.select("symbol", "eob", *[F.col(c).cast("double").alias(c) for c in (candidate, *pool, forward)]).dropna()
    schema = f"eob {dict(df.dtypes)['eob']}, n long, " + ", ".join(f"{c} double" for c in POOLED)
    return rows.groupBy("eob").applyInArrow(judged, schema).where(F.col("n") >= least)


def compare_to_pool(df: DataFrame, candidate: str, pool: list[str], forward: str, direction: int = 1, least: int = 5, least_dates: int = 2) -> DataFrame:
    """One row: the candidate's largest mean daily correlation with a pool member, and the means of POOLED over the dates.

    `direction` turns a candidate that bets on low values; redundancy is in absolute value. A mean over
    fewer than `least_dates` dates is null. The panel is shuffled by date twice, whatever the size of the pool.
    """
    rows = cut(df.select("symbol", "eob", (F.col(candidate) * direction).alias(candidate), *pool, forward))  # read by both reports
    both = rows.select("eob", *(F.when(F.col(candidate).isNotNull() & F.col(m).isNotNull(), F.col(c)).alias(f"{k}_{m}") for m in pool for k, c in (("a", candidate), ("b", m))))
    both = both.withColumns({f"{k}r_{m}": average_rank(f"{k}_{m}") for m in pool for k in "ab"})
    pearson = [F.when(F.count(f"a_{m}") >= least, correlation(f"a_{m}", f"b_{m}")).alias(f"p_{m}") for m in pool]
    spearman = [F.when(F.count(f"a_{m}") >= least, correlation(f"ar_{m}", f"br_{m}")).alias(f"s_{m}") for m in pool]
    mean = both.groupBy("eob").agg(*pearson, *spearman).agg(*[F.abs(F.avg(f"{k}_{m}")).alias(f"{k}_{m}") for m in pool for k in "ps"])
    worst = lambda k: F.array_max(F.array(*[F.col(f"{k}_{m}") for m in pool]))
    redundancy = mean.select(worst("p").alias("pearson_max_abs"), worst("s").alias("spearman_max_abs"))
    enough = lambda c: F.when(F.count(c) >= least_dates, F.avg(c))
    added = pool_by_date(rows, candidate, pool, forward, least).agg(
        *[enough(c).alias(c) for c in POOLED], enough(F.col("r2_after") - F.col("r2_before")).alias("r2_delta"), F.count("residual_ic").alias("dates"), F.count("r2_before").alias("r2_dates"),
    )
    return redundancy.withColumn("one_", F.lit(1)).join(added.withColumn("one_", F.lit(1)), "one_").drop("one_")  # one row each


def backtest_pair(df: DataFrame, before: str, after: str, signal_lag: int = 1, cost_rate: float = 0.0004) -> DataFrame:
    """Two books of target weights on one dense panel: figures of each and what the second changes, in one row.

    Both are executed on the same sorted rows and summed by date together, so the panel is read once.
    """
    rows = df.withColumns({"a_": executed(df, before, signal_lag), "b_": executed(df, after, signal_lag), "f_": ratio(lead("close"), F.col("close")) - 1})
    rows = rows.withColumns({f"t{k}": F.abs(F.col(f"{k}_") - F.coalesce(lag(f"{k}_"), F.lit(0.0))) for k in "ab"})
    daily = rows.groupBy("eob").agg(*[x for k in "ab" for x in (F.sum(F.col(f"{k}_") * F.col("f_")).alias(f"g{k}"), F.sum(f"t{k}").alias(f"t{k}"))]).where("ga IS NOT NULL")
    run = dates().rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumns({f"e{k}": F.product(1 + F.col(f"g{k}") - F.col(f"t{k}") * cost_rate).over(run) for k in "ab"})
    daily = daily.withColumns({f"d{k}": 1 - F.col(f"e{k}") / F.max(f"e{k}").over(run) for k in "ab"})
    out = daily.agg(F.count("*").alias("days"), *[x for k in "ab" for x in ((F.max_by(f"e{k}", "eob") - 1).alias(f"return_{k}"), F.max(f"d{k}").alias(f"drawdown_{k}"), F.avg(f"t{k}").alias(f"turnover_{k}"))])
    names = [(f, f"{f}_a", f"{f}_b") for f in ("return", "drawdown", "turnover")]
    return out.select("days", *[x for f, a, b in names for x in (F.col(a).alias(f"{f}_before"), F.col(b).alias(f"{f}_after"), (F.col(b) - F.col(a)).alias(f"{f}_delta"))])


# ---- robustness


def slices_of(regimes: dict[str, Column], scores: dict[str, str], delays: tuple[int, ...], leave_out: str | None) -> list[str]:
    """The names of the slices that `robustness` gives, but for those that leave one value of `leave_out` out."""
    return ["base", *(f"regime:{r}" for r in regimes), *(f"{s}:{side}" for s in scores for side in ("high", "low")), *(f"delay:{k}" for k in delays), "without_extremes"]


def robustness(df: DataFrame, factor: str, forward: str, regimes: dict[str, Column] | None = None, scores: dict[str, str] | None = None, delays: tuple[int, ...] = (1, 2), leave_out: str | None = None, window: int = 5, least: int = 5, least_dates: int = 2) -> DataFrame:
    """Mean, deviation and number of daily rank ICs in parts of the sample: one row a slice.

    Slices: the whole (base) and its halves by date; rolling means of `window` dates; dates or rows that a regime's
    condition marks; rows above and below the median of a score; the factor `delays` rows late; without the rows whose
    factor is beyond its 5 % or 95 % quantile in absolute value; and without each value of the column `leave_out`, of which the deviation
    of the means is one row (a row of the panel stands in as many slices as there are other values). Each
    row is unfolded into its slices, so the panel is sorted by symbol once and ranked by (slice, date) once. A mean
    over fewer than `least_dates` dates is null.
    """
    regimes, scores = regimes or {}, scores or {}
    # all slices and the cuts between them come from these rows, which are worked out once
    rows = cut(df.withColumns({f"late{k}": lag(factor, k) for k in delays}).where(F.col(forward).isNotNull()))
    # medians, quantiles and the values left out: one row of a few numbers
    cuts = rows.agg(F.struct(
        *[F.percentile(s, F.lit(0.5)).alias(f"m_{i}") for i, s in enumerate(scores.values())], F.percentile(F.abs(factor), F.lit(0.05)).alias("low_"), F.percentile(F.abs(factor), F.lit(0.95)).alias("high_"),
        *([F.collect_set(leave_out).alias("values_")] if leave_out else []),
    )).scalar()
    rows = rows.withColumn("cut_", cuts).select("*", "cut_.*")
    own = lambda name, there, x=factor: F.struct(F.lit(name).alias("slice"), F.when(there, F.col(x)).alias("x"))
    cells = [own("base", F.lit(True)), *(own(f"regime:{r}", c) for r, c in regimes.items())]
    for i, (name, s) in enumerate(scores.items()):
        cells += [own(f"{name}:high", F.col(s) >= F.col(f"m_{i}")), own(f"{name}:low", F.col(s) < F.col(f"m_{i}"))]
    cells += [own(f"delay:{k}", F.lit(True), f"late{k}") for k in delays]
    cells.append(own("without_extremes", F.abs(factor).between(F.col("low_"), F.col("high_"))))
    parts = F.array(*cells)
    if leave_out:
        others = F.transform(F.filter("values_", lambda v: v != F.col(leave_out)), lambda v: F.struct(F.concat(F.lit("out:"), v.cast("string")).alias("slice"), F.col(factor).alias("x")))
        parts = F.concat(parts, others)
    long = rows.select("eob", F.col(forward).alias("y"), F.explode(parts).alias("c")).select("eob", "y", "c.slice", "c.x").where("x IS NOT NULL")
    daily = rank_ic(long, "x", "y", least, ("slice", "eob")).where("ic IS NOT NULL")
    own = Window.partitionBy("slice").orderBy("eob")
    base = F.col("slice") == "base"
    daily = daily.withColumns({"place": F.row_number().over(own), "of": F.count("*").over(Window.partitionBy("slice")), "rolled": F.avg("ic").over(own.rowsBetween(-(window - 1), 0))})
    half = F.when(F.col("place") <= F.floor(F.col("of") / 2), "first_half").otherwise("second_half")
    more = F.when(base, F.array(F.struct(F.col("slice"), F.col("ic")), F.struct(half.alias("slice"), F.col("ic")), F.struct(F.lit("rolling").alias("slice"), F.when(F.col("place") >= window, F.col("rolled")).alias("ic"))))
    parts = daily.select(F.explode(F.coalesce(more, F.array(F.struct(F.col("slice"), F.col("ic"))))).alias("p")).select("p.slice", "p.ic").where("ic IS NOT NULL")
    means = parts.groupBy("slice").agg(F.when(F.count("ic") >= least_dates, F.avg("ic")).alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("dates"))
    if not leave_out:
        return means
    left = F.col("slice").startswith("out:")
    spread = means.where(left).agg(F.lit("leave_out").alias("slice"), F.avg("ic_mean").alias("ic_mean"), F.stddev_samp("ic_mean").alias("ic_std"), F.count("ic_mean").alias("dates"))
    return means.where(~left).unionByName(spread)
