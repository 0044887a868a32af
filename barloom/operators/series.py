"""Shapes and memory of single series: kernel densities of returns by lag, rescaled ranges, tests over recent windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import series
from barloom.operators.diagnostics import adf, kpss
from barloom.session import cut

#: The density's grid, -5 to 5 in deviations, and the bins between two of its points.
GRID, FINE = 1000, 8
LEAST_PEAK = 0.01
SHAPE = "symbol string, lag int, n long, peak_height double, peak_position double, num_peaks long, statistical_kurtosis double, statistical_skewness double"


def binned_density(bins: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The Gaussian kernel density with Scott's bandwidth (n ** -0.2 deviations) at the GRID points, of values shared among bins.

    Bin b lies at -5 + b * 10 / (GRID - 1) / FINE. Sharing a value between two bins errs by a fraction of
    (bin / bandwidth)^2 / 8 of the kernel's height: 2e-6 for 400 values, 5e-5 for a million.
    """
    step, width = 10 / (GRID - 1) / FINE, n**-0.2
    reach = int(math.ceil(9 * width / step))
    points = (GRID - 1) * FINE + 1
    held = np.zeros(points + 2 * reach)
    inside = (bins >= -reach) & (bins < points + reach)
    np.add.at(held, bins[inside] + reach, weights[inside])
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) * step / width) ** 2)
    size = 1 << (len(held) + len(kernel)).bit_length()
    whole = np.fft.irfft(np.fft.rfft(held, size) * np.fft.rfft(kernel, size), size)[2 * reach : 2 * reach + points]
    return whole[::FINE] / (n * width * math.sqrt(2 * math.pi))


def peaks(density: np.ndarray, least: float = LEAST_PEAK) -> int:
    """Inner points or plateaus above both neighbours and of height `least` at least."""
    change = np.flatnonzero(np.diff(density))
    firsts, lasts = np.concatenate([[0], change + 1]), np.concatenate([change, [len(density) - 1]])
    level = density[firsts]
    if len(level) < 3:
        return 0
    top = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:]) & (level[1:-1] >= least)
    return int(top.sum()) if lasts[-1] else 0


def density_shapes(df: DataFrame, x: str = "close", lags: tuple[int, ...] = tuple(range(1, 35))) -> DataFrame:
    """Of the standardised log returns of each symbol over each lag: the density's peak, its place and number, tails, and moments.

    All lags come from one sort. Values are shared among fixed bins and counted, so a series of any length
    is a few thousand numbers when its density is taken. Prices that are null or not positive are left out first; a
    (symbol, lag) of fewer than two returns or without spread gives no row.
    """
    rows = cut(df.where(F.col(x) > 0).select("symbol", "eob", F.log(x).alias("p")))  # moments first, then places by them
    rows = rows.withColumns({f"r{k}": F.col("p") - F.lag("p", k).over(series()) for k in lags})
    returns = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in lags])
    long = rows.select("symbol", F.explode(returns).alias("v")).select("symbol", "v.lag", "v.r").where("r IS NOT NULL")
    stats = long.groupBy("symbol", "lag").agg(
        F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), (F.kurtosis("r")).alias("statistical_kurtosis"), F.skewness("r").alias("statistical_skewness")
    ).where("std > 0")
    place = (((F.col("r") - F.col("mean")) / F.col("std") + 5) / (10 / (GRID - 1) / FINE)).alias("place")
    placed = long.join(stats.select("symbol", "lag", "n", "mean", "std"), ["symbol", "lag"]).select("symbol", "lag", place)
    low = F.floor("place")
    parts = F.array(F.struct(low.alias("bin"), (1 - (F.col("place") - low)).alias("w")), F.struct((low + 1).alias("bin"), (F.col("place") - low).alias("w")))
    bins = placed.select("symbol", "lag", F.explode(parts).alias("b")).groupBy("symbol", "lag", "b.bin").agg(F.sum("b.w").alias("w"))

    def shaped(held: pa.Table, own: pa.Table) -> pa.Table:
        n = own.column("n")[0].as_py()
        density = binned_density(held.column("bin").to_numpy(), held.column("w").to_numpy(), n)
        top = int(np.argmax(density))
        found = [[own.column(c)[0].as_py()] for c in ("symbol", "lag", "n")] + [[float(density[top])], [-5 + 10 * top / (GRID - 1)], [peaks(density)]]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        names = [c.split()[0] for c in SHAPE.split(", ")]
        return pa.Table.from_arrays([*(pa.array(v, k) for v, k in zip(found, kinds, strict=True)), own.column("statistical_kurtosis"), own.column("statistical_skewness")], names)

    stats = stats.select(*[F.col(c).alias(c) for c in stats.columns])  # names of its own beside the bins, which come from it
    out = bins.groupBy("symbol", "lag").cogroup(stats.groupBy("symbol", "lag")).applyInArrow(shaped, SHAPE)
    tail = F.when(F.col("peak_height") > 0.5, "fat_tail").when(F.col("peak_height") < -0.5, "thin_tail").otherwise("near_normal")
    skew = F.when(F.col("peak_position") > 0.2, "right_skew").when(F.col("peak_position") < -0.2, "left_skew").otherwise("symmetric")
    return out.withColumns({"tail_feature": tail, "skew_feature": skew})


def by_period(df: DataFrame, periods: dict[str, Column], x: str = "close", lags: tuple[int, ...] = tuple(range(1, 35))) -> DataFrame:
    """`density_shapes` of the last price of every period: label -> the period's start as a column of `eob`."""
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("period"), start.cast("timestamp_ntz").alias("at")) for name, start in periods.items()]))
    last = df.select("symbol", "eob", x, cells.alias("p")).groupBy("symbol", "p.period", "p.at").agg(F.max_by(x, F.when(F.col(x).isNotNull(), F.col("eob"))).alias(x))
    both = last.select(F.concat_ws("\u0001", "period", "symbol").alias("symbol"), F.col("at").alias("eob"), x)
    part = F.split("symbol", "\u0001", 2)
    return density_shapes(both, x, lags).withColumns({"period": part[0], "symbol": part[1]})


# ---- memory


def ranges_of(returns: np.ndarray, lag: int, begin: int) -> tuple[float, int]:
    """Sum and number of range / deviation over the windows of `lag` returns that end at `begin` or later; windows without spread do not count."""
    start = max(0, begin - lag + 1)
    if len(returns) - start < lag:
        return 0.0, 0
    own = np.lib.stride_tricks.sliding_window_view(returns[start:], lag)
    off = np.cumsum(own - own.mean(axis=1, keepdims=True), axis=1)
    spread = own.std(axis=1, ddof=1)
    held = spread > 1e-14
    return float(((off.max(axis=1) - off.min(axis=1))[held] / spread[held]).sum()), int(held.sum())


def hurst(df: DataFrame, x: str = "close", low: int = 10, high: int = 100) -> DataFrame:
    """The rescaled-range exponent of each symbol: the slope of log mean range / deviation on log lag, lags `low` to `high`.

    A task streams its sorted symbols and carries the last `high` returns from batch to batch, so it sums every window of
    every lag once and holds no series whole; sums and numbers of windows add up. Prices that are null or not
    positive are left out. The highest lag is half the series at most; with fewer returns than that, or with fewer
    than three lags that have windows, the exponent is null. Returns symbol, hurst, lags, n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, tail = None, np.empty(0)
        for batch in batches:
            names, values, out, at = batch.column("symbol").to_pylist(), batch.column("r").to_numpy(zero_copy_only=False), [], 0
            while at < len(names):
                stop = at + 1
                while stop < len(names) and names[stop] == names[at]:
                    stop += 1
                if names[at] != symbol:
                    symbol, tail = names[at], np.empty(0)
                whole = np.concatenate([tail, values[at:stop]])
                out.append((symbol, 0, 0.0, stop - at))
                out += [(symbol, lag, *ranges_of(whole, lag, len(tail))) for lag in range(low, high + 1)]
                tail, at = whole[-(high - 1) :] if high > 1 else whole[:0], stop
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], ["symbol", "lag", "total", "n"])

    rows = df.where(F.col(x) > 0).withColumn("r", F.log(x) - F.lag(F.log(x)).over(series())).where("r IS NOT NULL").select("symbol", "eob", "r")
    parts = rows.sortWithinPartitions("symbol", "eob").mapInArrow(run, "symbol string, lag int, total double, n long")
    sums = parts.groupBy("symbol", "lag").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    returns = F.max(F.when(F.col("lag") == 0, F.col("n"))).over(Window.partitionBy("symbol"))
    sums = sums.withColumn("returns", returns).withColumn("most", F.least(F.lit(high), F.floor((F.col("returns") + 1) / 2)))
    used = (F.col("lag") > 0) & (F.col("n") > 0) & (F.col("lag") <= F.col("most")) & (F.col("returns") > F.col("most"))
    u, v = F.when(used, F.log("lag")), F.when(used, F.log(F.try_divide("total", "n")))
    slope = F.when(F.count(v) >= 3, F.try_divide(F.covar_pop(v, u), F.var_pop(u)))
    return sums.groupBy("symbol").agg(slope.alias("hurst"), F.count(v).alias("lags"), (F.max("returns") + 1).alias("n"))


def recent_windows(df: DataFrame, windows: tuple[int, ...] = (20, 40, 60), x: str = "close", by_year: bool = False) -> DataFrame:
    """Exponent, unit-root and stationarity tests over the last rows of each symbol (of each of its years, `by_year`): one row a window.

    Each window's rows stand as a series of their own, so all windows go through each test in one plan. The
    exponent takes lags from a sixth (5 at least) to a third (10 at least) of the window.
    """
    own = ["symbol", F.year("eob").alias("year")] if by_year else ["symbol", F.lit(None).cast("int").alias("year")]
    rows = df.where(F.col(x).isNotNull()).select(*own, "eob", x)
    place = Window.partitionBy("symbol", "year").orderBy(F.desc("eob"))
    rows = rows.withColumn("back", F.row_number().over(place)).withColumn("all", F.count("*").over(Window.partitionBy("symbol", "year")))
    held = F.filter(F.array(*map(F.lit, windows)), lambda w: (w >= F.col("back")) & ((w <= F.col("all")) if by_year else F.lit(True)))
    name = F.concat_ws("\u0001", F.col("window").cast("string"), F.coalesce(F.col("year").cast("string"), F.lit("")), "symbol")
    rows = rows.select("symbol", "year", "eob", x, F.explode(held).alias("window")).select(name.alias("symbol"), "eob", x)
    rows, memory = cut(rows), None  # each test reads these rows
    for w in windows:  # the lags depend on the window; each branch reads its own rows alone
        some = hurst(rows.where(F.col("symbol").startswith(f"{w}\u0001")), x, max(5, w // 6), min(max(10, w // 3), w // 2)).select("symbol", "hurst")
        memory = some if memory is None else memory.unionByName(some)
    unit = adf(rows, x).select("symbol", "n_obs", F.col("lags").alias("adf_lags"), F.col("statistic").alias("adf_statistic"), F.col("p_value").alias("adf_p_value"))
    level = kpss(rows, x, trend=True).select("symbol", F.col("lags").alias("kpss_lags"), F.col("statistic").alias("kpss_statistic"), F.col("p_value").alias("kpss_p_value"))
    tests = unit.join(level, "symbol", "full").join(memory, "symbol", "full")
    part = F.split("symbol", "\u0001", 3)
    return tests.withColumns({"window": part[0].cast("int"), "year": F.when(part[1] != "", part[1].cast("int")), "symbol": part[2]})
