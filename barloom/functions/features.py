"""Feature tables over the (symbol, eob) panel, and the two written forms of exchange symbols."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import change, lag, ratio, rolling

PRICES = ("open", "close", "high", "low")
LAGS = (1, 2, 3, 4, 5, 10, 15, 20, 25)


def shifts_for(lookback: int) -> tuple[int, ...]:
    """The last `lookback` bars, then as many steps of five bars."""
    return (*range(lookback), *range(5, 5 * lookback + 1, 5))


def logdiff_features(bars: DataFrame, factors: tuple[str, ...] = PRICES, lags: tuple[int, ...] = LAGS, shifts: tuple[int, ...] | None = None, lookback: int = 5) -> DataFrame:
    """Log differences of each pair of prices and lag, at each shift; rows with a missing one go.

    Only the distinct lags of the few logs are windows, in one sort; the many features are differences of
    them in one projection. Prices that are not positive are missing.
    """
    if not factors or not lags or lookback < 1 or min(lags) < 1:
        raise ValueError("factors and lags must be given, lags and lookback positive")
    shifts = shifts_for(lookback) if shifts is None else shifts
    logs = bars.withColumns({f"log_{f}": F.when(F.col(f) > 0, F.ln(f)) for f in factors})
    reach = sorted({s for s in shifts} | {s + k for s in shifts for k in lags})
    logs = logs.withColumns({f"log_{f}_{k}": lag(f"log_{f}", k) if k else F.col(f"log_{f}") for f in factors for k in reach})
    made = {f"logdiff_{a}_{b}{k}_shift{s}": F.col(f"log_{a}_{s}") - F.col(f"log_{b}_{s + k}") for a, b, k in product(factors, factors, lags) for s in shifts}
    return logs.select(*bars.columns, *[x.alias(n) for n, x in made.items()]).dropna(subset=list(made))


def price_volume_features(bars: DataFrame, lookback: int = 5) -> DataFrame:
    """Log differences of the last bars, returns, distances from means, volatilities and bar shapes; rows with a missing one go."""
    steps, spans = (1, 2, 3, 5, 10, 20, 40, 60, 120, 160), (10, 20, 40, 60, 120, 160)
    more = {f"return_{k}": change("close", k) for k in steps} | {f"ma_gap_{k}": ratio("close", rolling(F.avg, "close", k)) - 1 for k in spans}
    more |= {"intraday_return": ratio("close", "open") - 1, "high_low_range": ratio("high", "low") - 1, "volume_change_5": change("volume", 5)}
    wide = bars.withColumns(more)
    wide = wide.withColumns({f"volatility_{k}": rolling(F.stddev_samp, "return_1", k) for k in spans})
    names = [*more, *[f"volatility_{k}" for k in spans]]
    return logdiff_features(wide, lags=(1, 2, 3, 4, 5), shifts=tuple(range(lookback)), lookback=lookback).dropna(subset=names)


# Exchange prefixes and the suffixes that stand for them in the other form.
EXCHANGES = {
    "SHSE": "SH", "SZSE": "SZ", "SHFE": "SHF", "DCE": "DCE", "CZCE": "CZC",
    "CFFEX": "CFE", "INE": "INE", "GFEX": "GFE", "HKEX": "HK", "NASDAQ": "NB",
}
FUTURES = ("SHFE", "DCE", "CZCE", "CFFEX", "INE", "GFEX")


def _looked_up(x: Column, table: dict[str, str]) -> Column:
    return F.get(F.array(*map(F.lit, table.values())), F.array_position(F.array(*map(F.lit, table)), x).cast("int") - 1)


def _checked(symbol: Column, made: Column, strict: bool) -> Column:
    bad = F.raise_error(F.concat(F.lit("unknown exchange in symbol "), symbol)).cast("string") if strict else symbol
    return F.when(symbol.isNull(), F.lit(None).cast("string")).when(made.isNull(), bad).otherwise(made)


def to_suffixed(symbol: Column, strict: bool = False) -> Column:
    """`SHFE.RB99` as `RB_DOMINANT.SHF`; symbols of unknown exchanges stay, or raise if `strict`."""
    prefix = F.substring_index(symbol, ".", 1)
    code = F.regexp_replace(symbol, r"^[^.]*\.", "")
    code = F.when(prefix.isin(*FUTURES), F.regexp_replace(code, "^(.+)99$", "$1_DOMINANT")).otherwise(code)
    return _checked(symbol, F.when(symbol.contains("."), F.concat(code, F.lit("."), _looked_up(prefix, EXCHANGES))), strict)


def to_prefixed(symbol: Column, strict: bool = False) -> Column:
    """`RB_DOMINANT.SHF` as `SHFE.RB99`; symbols of unknown exchanges stay, or raise if `strict`."""
    prefix = _looked_up(F.substring_index(symbol, ".", -1), {s: p for p, s in EXCHANGES.items()})
    code = F.regexp_replace(symbol, r"\.[^.]*$", "")
    code = F.when(prefix.isin(*FUTURES), F.regexp_replace(code, "^(?<code>.+)_DOMINANT$", "${code}99")).otherwise(code)
    return _checked(symbol, F.when(symbol.contains("."), F.concat(prefix, F.lit("."), code)), strict)
