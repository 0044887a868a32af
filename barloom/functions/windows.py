"""Rolling, ranking and smoothing helpers over the (symbol, eob) panel.

Missing is NULL. All series functions run in windows partitioned by symbol and ordered by eob; stages
that build on one window share its sort. Frames count rows, and `least` guards the warm-up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def series() -> WindowSpec:
    """A symbol's rows in time (a function, as a window needs a session)."""
    return Window.partitionBy("symbol").orderBy("eob")


def prefix() -> WindowSpec:
    """A symbol's rows up to the present one."""
    return series().rowsBetween(Window.unboundedPreceding, 0)


def by_date() -> WindowSpec:
    """A date's rows."""
    return Window.partitionBy("eob")


def dates() -> WindowSpec:
    """One row a date, in time: small whatever the panel."""
    return Window.orderBy("eob")


def dates_prefix() -> WindowSpec:
    return dates().rowsBetween(Window.unboundedPreceding, 0)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frame(n: int) -> WindowSpec:
    """The last n rows, the current one included."""
    return series().rowsBetween(-(n - 1), 0)


def rolling(fn: Callable[..., Column], x: Column | str, n: int, least: int | None = None) -> Column:
    """An aggregate over the last n rows, null until `least` (n if not given) values are there."""
    return F.when(F.count(col(x)).over(frame(n)) >= (n if least is None else least), fn(col(x)).over(frame(n)))


def rolling2(fn: Callable[..., Column], y: Column | str, x: Column | str, n: int, least: int | None = None) -> Column:
    """An aggregate of pairs over the last n rows, null until `least` whole pairs are there."""
    both = F.when(col(y).isNotNull() & col(x).isNotNull(), 1)
    return F.when(F.count(both).over(frame(n)) >= (n if least is None else least), fn(col(y), col(x)).over(frame(n)))


def lag(x: Column | str, k: int = 1) -> Column:
    return F.lag(col(x), k).over(series())


def lead(x: Column | str, k: int = 1) -> Column:
    return F.lead(col(x), k).over(series())


def filled(x: Column | str) -> Column:
    """The last value that is not null."""
    return F.last(col(x), ignorenulls=True).over(prefix())


def ratio(x: Column | str, y: Column | str) -> Column:
    """x / y; null, not an error, where y is 0."""
    return F.try_divide(col(x), col(y))


def safe_divide(x: Column | str, y: Column | str, fill: float = 0.0) -> Column:
    """x / y with `fill` for anything undefined, the warm-up included."""
    return F.coalesce(ratio(x, y), F.lit(fill))


def change(x: Column | str = "close", k: int = 1) -> Column:
    """Relative change over k rows."""
    return ratio(x, lag(x, k)) - 1


def clip(x: Column, low: float, high: float) -> Column:
    """x held in [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def row_no() -> Column:
    return F.row_number().over(series()).cast("double")


def stages(df: DataFrame, *steps: dict[str, Column], keep: tuple[str, ...] = ("value",)) -> DataFrame:
    """Columns added step by step (windows cannot be nested in one step); only those in `keep` stay."""
    before = df.columns
    for step in steps:
        df = df.withColumns(step)
    return df.select(*before, *keep)


def zscore(x: Column | str, n: int, least: int | None = None, floor: float = 1e-6) -> Column:
    """(x - mean) / std over the last n rows; the std is at least `floor`, also where it is undefined."""
    mean = rolling(F.avg, x, n, n // 2 if least is None else least)
    std = rolling(F.stddev_samp, x, n, n // 2 if least is None else least)
    return (col(x) - mean) / F.when(std > floor, std).otherwise(F.lit(floor))


def zscore_or_null(x: Column | str, n: int, least: int, tiny: float = 1e-8) -> Column:
    """(x - mean) / std over the last n rows; null where the std is not above `tiny`."""
    std = rolling(F.stddev_samp, x, n, least)
    return ratio(col(x) - rolling(F.avg, x, n, least), F.when(std > tiny, std))


def correlation(y: Column | str, x: Column | str) -> Column:
    """Pearson correlation of the whole pairs of a group; null, not an error, where a side is constant."""
    both = col(y).isNotNull() & col(x).isNotNull()
    a, b = F.when(both, col(y)), F.when(both, col(x))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rolling_correlation(y: Column | str, x: Column | str, n: int, least: int | None = None, tiny: float = 1e-10) -> Column:
    """Correlation of the whole pairs of the last n rows; null where a side's deviation is not above `tiny`."""
    both = col(y).isNotNull() & col(x).isNotNull()
    a, b = F.when(both, col(y)), F.when(both, col(x))
    s, t = F.stddev_pop(a).over(frame(n)), F.stddev_pop(b).over(frame(n))
    value = F.try_divide(F.covar_pop(a, b).over(frame(n)), s * t)
    return F.when((F.count(a).over(frame(n)) >= (n if least is None else least)) & (s > tiny) & (t > tiny), value)


def smoothed(df: DataFrame, columns: dict[str, tuple[str, float]]) -> DataFrame:
    """The rows with exponential means added: new column -> (column, alpha), in the recursive form seeded at the first value.

    One pass over each symbol's sorted rows with the state carried from batch to batch, so the cost is the
    number of rows and a task holds one batch. At a null the mean stays, and weighs less at the next value.
    """
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, state = None, {}
        for batch in batches:
            symbols = batch.column("symbol").to_pylist()
            series_ = {out: batch.column(x).to_pylist() for out, (x, _) in columns.items()}
            made: dict[str, list[float | None]] = {out: [] for out in names}
            for i, own in enumerate(symbols):
                if own != symbol:
                    symbol, state = own, {out: (None, 1.0) for out in names}
                for out, (_, alpha) in columns.items():
                    mean, weight = state[out]
                    x = series_[out][i]
                    if x is not None and mean is None:
                        mean = x
                    elif mean is not None:
                        weight *= 1 - alpha
                        if x is not None:
                            mean, weight = (weight * mean + alpha * x) / (weight + alpha), 1.0
                    state[out] = (mean, weight)
                    made[out].append(mean)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(made[out], pa.float64()) for out in names]], [*batch.schema.names, *names])

    schema = T.StructType([*df.schema.fields, *[T.StructField(out, T.DoubleType()) for out in names]])
    return df.repartition("symbol").sortWithinPartitions("symbol", "eob").mapInArrow(run, schema)


def scanned(df: DataFrame, machine: Callable[[], Callable[..., tuple]], columns: tuple[str, ...], out: tuple[str, ...], backwards: bool = False) -> DataFrame:
    """The rows with the columns `out` added, which a machine of its own gives at each row of a symbol from `columns`, in order of time or against it.

    As with `smoothed`, a task streams sorted symbols, holds one batch and carries the state on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, step = None, None
        for batch in batches:
            made = []
            for own, *values in zip(*(batch.column(c).to_pylist() for c in ("symbol", *columns)), strict=True):
                if step is None or own != symbol:
                    symbol, step = own, machine()
                made.append(step(*values))
            added = [pa.array([m[i] for m in made], pa.float64()) for i in range(len(out))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *out])

    schema = T.StructType([*df.schema.fields, *[T.StructField(o, T.DoubleType()) for o in out]])
    return df.repartition("symbol").sortWithinPartitions("symbol", F.desc("eob") if backwards else "eob").mapInArrow(run, schema)


def kalman_smoothed(df: DataFrame, x: str = "close", noise: float = 1.0, drift: float = 0.1, out: str = "smoothed") -> DataFrame:
    """The rows with a column's smoothed level added: a walk with variance `drift` seen with variance `noise`, filtered forwards, smoothed backwards.

    Two passes over each symbol's sorted rows. It looks ahead, so it serves labels and reports, not signals. A
    missing value leaves the level as it was and its variance larger; before the first value the level is null.
    """

    def ahead() -> Callable[..., tuple]:
        level, spread = None, 0.0

        def step(value: float | None) -> tuple:
            nonlocal level, spread
            if level is None:
                level, spread = value, noise
            else:
                spread += drift
                if value is not None:
                    gain = spread / (spread + noise)
                    level, spread = level + gain * (value - level), (1 - gain) * spread
            return level, spread

        return step

    def back() -> Callable[..., tuple]:
        later = None

        def step(level: float | None, spread: float) -> tuple:
            nonlocal later
            later = level if later is None or level is None else level + spread / (spread + drift) * (later - level)
            return (later,)

        return step

    rows = scanned(df.withColumn("x_", col(x).cast("double")), ahead, ("x_",), ("f_", "s_"))
    return scanned(rows, back, ("f_", "s_"), (out,), backwards=True).drop("x_", "f_", "s_")


def average_rank(x: Column | str, by: tuple[str, ...] = ("eob",), descending: bool = False) -> Column:
    """Rank with ties at their mean, among rows of a group whose x is not null."""
    own = col(x)
    group = Window.partitionBy(*by)
    # nulls come last and take no part; ties share the mean of the first rank from either end
    ranked = F.rank().over(group.orderBy(own.desc_nulls_last() if descending else own.asc_nulls_last()))
    reverse = F.rank().over(group.orderBy(own.asc_nulls_last() if descending else own.desc_nulls_last()))
    return F.when(own.isNotNull(), (ranked + F.count(own).over(group) + 1 - reverse) / 2)


def percent_rank(x: Column | str, by: tuple[str, ...] = ("eob",)) -> Column:
    """Average rank as a share of the group's values."""
    return average_rank(x, by) / F.count(col(x)).over(Window.partitionBy(*by))


def min_rank(x: Column | str, by: tuple[str, ...] = ("eob",)) -> Column:
    """Rank from the highest, ties at their lowest rank; null stays null."""
    own = col(x)
    return F.when(own.isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(own.desc_nulls_last())))


def first_rank(x: Column | str, by: tuple[str, ...] = ("eob",), tie: str = "symbol") -> Column:
    """Place from the highest; ties go by `tie`."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(col(x).desc_nulls_last(), F.col(tie)))


def population_z(x: Column | str, by: tuple[str, ...] = ("eob",)) -> Column:
    """(x - mean) / population std in a group; 0 where all values are equal."""
    group = Window.partitionBy(*by)
    return F.when(col(x).isNotNull(), F.coalesce(F.try_divide(col(x) - F.avg(col(x)).over(group), F.stddev_pop(col(x)).over(group)), F.lit(0.0)))
