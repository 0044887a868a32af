"""Summaries of attributions, edges and tests; ledgers of weights; groups that are held between rebalances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import change, correlation, dates
from barloom.operators.portfolio import metrics
from barloom.operators.research import overfitting, regression_attribution

CASH = "CASH"


# ---- ledgers


def weight_ledger(weights: DataFrame, strategy: str, weight: str | None = None) -> DataFrame:
    """eob, strategy, symbol, weight from a long ledger (a column `symbol`) or from a wide one (a column for each symbol); null weights go.

    Of a long ledger the column `weight` counts, else the first of weight, executed, target.
    """
    if "symbol" not in weights.columns:
        long = weights.unpivot(["eob"], [c for c in weights.columns if c != "eob"], "symbol", "weight")
    else:
        names = [weight] if weight else [c for c in ("weight", "executed", "target") if c in weights.columns]
        if not names or names[0] not in weights.columns:
            raise ValueError("the ledger has no column of weights")
        long = weights.select("eob", "symbol", F.col(names[0]).alias("weight"))
    return long.where("weight IS NOT NULL").select("eob", F.lit(strategy).alias("strategy"), "symbol", F.col("weight").cast("double").alias("weight"))


def with_cash(rows: DataFrame, by: tuple[str, ...] = ("eob",), category: str = "category") -> DataFrame:
    """Category rows of a book and its benchmark, and a row of cash where either's weights leave something to the larger of both sums and 1.

    rows: `by`, category, portfolio_weight, benchmark_weight, portfolio_contrib, benchmark_contrib; cash contributes nothing.
    """
    sums = rows.groupBy(*by).agg(F.coalesce(F.sum("portfolio_weight"), F.lit(0.0)).alias("p_"), F.coalesce(F.sum("benchmark_weight"), F.lit(0.0)).alias("b_"))
    whole = F.greatest("p_", "b_", F.lit(1.0))
    cash = sums.select(*by, F.lit(CASH).alias(category), (whole - F.col("p_")).alias("portfolio_weight"), (whole - F.col("b_")).alias("benchmark_weight"), F.lit(0.0).alias("portfolio_contrib"), F.lit(0.0).alias("benchmark_contrib"))
    return rows.unionByName(cash.where((F.abs("portfolio_weight") > 1e-12) | (F.abs("benchmark_weight") > 1e-12)), allowMissingColumns=True)


# ---- factor attribution


def factor_contributions(df: DataFrame, factors: list[str], target: str, weight: str, benchmark: str | None = None, ridge: float = 1e-3) -> DataFrame:
    """Of each date and factor: its ridge coefficient, the book's active exposure to its z-score, and what both bring together: eob, term, status, beta, active_exposure, contribution.

    A date whose regression has too few whole rows is skipped, with null figures.
    """
    whole = df.dropna(subset=[*factors, target])
    z = {f"z_{f}": F.coalesce(F.try_divide(F.col(f) - F.avg(f).over(Window.partitionBy("eob")), F.nullif(F.stddev_pop(f).over(Window.partitionBy("eob")), F.lit(0.0))), F.lit(0.0)) for f in factors}
    active = F.coalesce(weight, F.lit(0.0)) - (F.coalesce(benchmark, F.lit(0.0)) if benchmark else F.lit(0.0))
    held = whole.withColumns(z).groupBy("eob").agg(F.array(*[F.struct(F.lit(f).alias("term"), F.sum(active * F.col(f"z_{f}")).alias("active_exposure")) for f in factors]).alias("e_"))
    exposures = df.select("eob").distinct().join(held, "eob", "left")
    terms = F.coalesce("e_", F.array(*[F.struct(F.lit(f).alias("term"), F.lit(None).cast("double").alias("active_exposure")) for f in factors]))
    long = exposures.select("eob", F.explode(terms).alias("e")).select("eob", "e.*")
    betas = regression_attribution(df, factors, target, ridge).where("term <> 'intercept'")
    both = long.join(betas, ["eob", "term"], "left")
    ok = F.col("beta").isNotNull()
    return both.select("eob", "term", F.when(ok, "ok").otherwise("skipped").alias("status"), "beta", F.when(ok, F.col("active_exposure")).alias("active_exposure"), (F.col("beta") * F.col("active_exposure")).alias("contribution"))


def summarize_contributions(rows: DataFrame, by: tuple[str, ...] = ("term",)) -> DataFrame:
    """Means and sums of factor attributions over the dates, with the dates that counted and those that were skipped."""
    return rows.groupBy(*by).agg(
        F.avg("beta").alias("avg_beta"), F.avg("active_exposure").alias("avg_active_exposure"), F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("total_contribution"), F.avg("contribution").alias("avg_contribution"),
        F.sum((F.col("status") == "ok").cast("long")).alias("ok_days"), F.sum((F.col("status") != "ok").cast("long")).alias("skipped_days"), F.count("*").alias("n_days"),
    )


# ---- edges


def ablation_edges(deltas: DataFrame) -> DataFrame:
    """Mean differences of the variants without a player: removed_player, ablation_type, n_variants and edges. Rows without a removed player do not count."""
    rows = deltas.where("removed_player IS NOT NULL AND removed_player <> ''")
    kind = F.col("ablation_type") if "ablation_type" in deltas.columns else F.lit("unknown")
    out = rows.groupBy("removed_player", kind.alias("ablation_type")).agg(
        F.count("*").alias("n_variants"), F.avg("delta_return").alias("return_edge"), F.avg("delta_drawdown").alias("drawdown_edge"), F.avg("delta_turnover").alias("turnover_edge"), F.avg("delta_cost").alias("cost_edge"),
    )
    return out.withColumns({"drawdown_relief": -F.col("drawdown_edge"), "cost_saving": -F.col("cost_edge"), "net_edge": F.col("return_edge")})


EDGES = ("topk_entry_edge", "exit_prevent_edge", "entry_critical", "exit_critical", "hold_critical", "topk_edge")


def decision_edges(rows: DataFrame, by: tuple[str, ...] = ("player",)) -> DataFrame:
    """Of each player its rows, those that were judged, how often each edge of EDGES held, and the mean push in rank where one did; edges that the rows lack did not hold."""
    flag = {e: F.coalesce(F.col(e).cast("boolean"), F.lit(False)) if e in rows.columns else F.lit(False) for e in EDGES}
    critical = flag["entry_critical"] | flag["exit_critical"] | flag["hold_critical"]
    decided = critical | flag["topk_entry_edge"] | flag["exit_prevent_edge"] | flag["topk_edge"]
    push = F.col("rank_push").cast("double") if "rank_push" in rows.columns else F.lit(None).cast("double")
    ok = F.coalesce(F.col("status") == "ok", F.lit(False)) if "status" in rows.columns else F.lit(False)
    number = lambda c, name: F.sum(c.cast("long")).alias(name)
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), number(ok, "ok_rows"), number(~ok, "skipped_rows"), *[number(f, f"{e}_count") for e, f in flag.items()],
        number(critical, "critical_count"), F.avg(F.when(decided, push)).alias("avg_rank_push"), number(F.coalesce(push > 0, F.lit(False)), "positive_rank_push_count"),
    )


def grouped_players(players: DataFrame) -> DataFrame:
    """The players of each group in the order they were first seen, and the groups' own order: group, place, players. players: player, group, seen."""
    own = players.groupBy("group", "player").agg(F.min("seen").alias("seen"))
    groups = own.groupBy("group").agg(F.min("seen").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("seen", "player"))), lambda s: s["player"]).alias("players"))
    return groups.select("group", F.row_number().over(Window.orderBy("first")).alias("place"), "players")


# ---- overfitting over several partitions


def overfitting_sensitivity(candidates: DataFrame, splits: tuple[int, ...] = (4, 6, 8), threshold: float = 0.2) -> DataFrame:
    """The share of halves whose best candidate falls to the lower half outside, for each number of blocks: one row each.

    A number of blocks that is odd, below two or above the number of dates is kept as an unavailable row.
    """
    spark, days = candidates.sparkSession, candidates.select("eob").distinct().count()
    n = candidates.select("candidate").distinct().count()
    out = None
    for s in splits:
        if s < 2 or s % 2 or s > days or n < 2:
            row = spark.createDataFrame([(s, 0, None, None, None, "watch", "unavailable")], "n_splits int, n_trials long, pbo double, standard_error double, stability double, flag string, status string")
        else:
            fails = F.avg((F.col("logit") <= 0).cast("double"))
            row = overfitting(candidates, s).agg(F.count("*").alias("n_trials"), fails.alias("pbo"))
            row = row.select(
                F.lit(s).alias("n_splits"), "n_trials", "pbo", F.sqrt(F.col("pbo") * (1 - F.col("pbo")) / F.col("n_trials")).alias("standard_error"), (1 - F.col("pbo")).alias("stability"),
                F.when(F.col("pbo") <= threshold, "advance").otherwise("watch").alias("flag"), F.lit("ok").alias("status"),
            )
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no numbers of blocks asked for")
    return out


# ---- exits


def summarize_exits(books: dict[str, tuple[DataFrame, DataFrame]], triggers: dict[str, DataFrame]) -> DataFrame:
    """One row an exit rule: what it changes in the figures of the book, and how often and when it acted.

    books: name -> daily results without and with it; triggers: name -> one row with hit_rate, exposure_mean and forward means.
    """
    out = None
    for name, (base, variant) in books.items():
        a, b = (metrics(d).select(*[F.col(c).alias(f"{c}_{k}") for c in ("ann_return", "max_drawdown", "sharpe", "calmar", "sortino", "avg_turnover")]) for k, d in (("a", base), ("b", variant)))
        row = a.crossJoin(b).crossJoin(triggers[name])  # one row each
        d = lambda c, n: (F.col(f"{c}_b") - F.col(f"{c}_a")).alias(n)
        row = row.select(F.lit(name).alias("name"), d("ann_return", "d_return"), d("max_drawdown", "d_drawdown"), d("sharpe", "d_sharpe"), d("calmar", "d_calmar"), d("sortino", "d_sortino"), d("avg_turnover", "d_turnover"), *triggers[name].columns)
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no exit rules")
    return out


# ---- cross-sections by value, groups that are held


def value_ic(df: DataFrame, factor: str, target: str, least: int = 2, by: tuple[str, ...] = ("eob",)) -> DataFrame:
    """Pearson correlation of factor and target in each group with `least` whole pairs or more."""
    pairs = df.where(F.col(factor).isNotNull() & F.col(target).isNotNull())
    return pairs.groupBy(*by).agg(correlation(factor, target).alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least)


def ic_statistics(daily: DataFrame) -> DataFrame:
    """Of daily correlations (eob, ic): mean, deviation, ratio, share above 0 and beyond 2 %, and the t statistic of the mean."""
    s, n = F.stddev_samp("ic"), F.count("ic")
    return daily.agg(
        F.avg("ic").alias("ic_mean"), s.alias("ic_std"), F.try_divide(F.avg("ic"), s).alias("ic_ir"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"),
        F.avg((F.abs("ic") > 0.02).cast("double")).alias("beyond_2pct"), (F.try_divide(F.avg("ic"), s) * F.sqrt(n.cast("double"))).alias("t_stat"), n.alias("n"),
    )


def held_groups(df: DataFrame, factor: str, every: int, groups: int) -> tuple[DataFrame, DataFrame]:
    """Daily mean change of quantile groups that are formed on every `every`-th date and held until the next, and the part of each group that leaves it then.

    Returns (eob, grp, ret) and (eob, grp, turnover). Rows without a factor or a change over the bar before take no part. Groups are
    cut at even quantiles of the values; ties have the place of the first of them.
    """
    rows = df.withColumn("r_", change()).where(F.col(factor).isNotNull() & F.col("r_").isNotNull()).select("symbol", "eob", F.col(factor).alias("x_"), "r_")
    calendar = df.select("eob").distinct().withColumn("t_", F.row_number().over(dates()) - 1)
    rows = rows.join(calendar, "eob").withColumn("run", F.floor(F.col("t_") / every))
    day = Window.partitionBy("eob")
    first = F.rank().over(day.orderBy("x_")) - 1
    made = rows.where(F.col("t_") % every == 0).withColumns({"p_": first, "m_": F.count("*").over(day)})
    made = made.select("run", "eob", "symbol", F.greatest(F.lit(1), F.ceil(F.try_divide(F.col("p_") * groups, F.col("m_") - 1))).cast("int").alias("grp"))
    made = made.withColumn("grp", F.coalesce("grp", F.lit(1)))
    daily = rows.join(made.select("run", "symbol", "grp"), ["run", "symbol"]).groupBy("eob", "grp").agg(F.avg("r_").alias("ret"))
    later = made.select((F.col("run") - 1).alias("run"), "symbol", F.col("grp").alias("then_"))
    ends = calendar.where(F.col("t_") % every == 0).select("eob", (F.floor(F.col("t_") / every) - 1).alias("run"))
    gone = made.drop("eob").join(later, ["run", "symbol"], "left").join(ends, "run")
    turnover = gone.groupBy("eob", "grp").agg(F.avg((~F.col("grp").eqNullSafe(F.col("then_"))).cast("double")).alias("turnover"))
    return daily, turnover


def segmented(daily: DataFrame, segments: dict[str, Column], by: tuple[str, ...], least: int = 2) -> DataFrame:
    """Means and ratios of daily correlations within named parts of the calendar, which may overlap: segment, `by`, ic_mean, ic_ir, n; fewer than `least` give none."""
    named = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in segments.items()]), lambda s: s.isNotNull())
    rows = daily.withColumn("segment", F.explode(named))
    out = rows.groupBy("segment", *by).agg(F.avg("ic").alias("ic_mean"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("ic_ir"), F.count("ic").alias("n"))
    return out.where(F.col("n") >= least)
