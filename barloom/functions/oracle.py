"""DuckDB SQL in the shape of the panel queries: sources and window fragments."""

from __future__ import annotations

ORDER = "(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"

#: Bars of unit prices by brand and week.
BRAND_WEEK = f"""
ticks AS (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON p_partkey = l_partkey),
bars AS (SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS eob, arg_min(price, {ORDER}) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, {ORDER}) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume FROM ticks GROUP BY ALL)"""

BRAND_MONTH = BRAND_WEEK.replace("'week'", "'month'")

#: Daily bars of event values by type.
EVENT_DAY = """
bars AS (SELECT event_type AS symbol, CAST(date_trunc('day', ts) AS DATE) AS eob, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL)"""

#: Monthly bars by nation, with the region as category.
NATION_MONTH = f"""
ticks AS (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
bars AS (SELECT n_name AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS eob, arg_min(price, {ORDER}) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, {ORDER}) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume, any_value(r_name) AS category FROM ticks GROUP BY n_name, 2)"""

SERIES = "PARTITION BY symbol ORDER BY eob"


def over(n: int | None = None) -> str:
    """The series window, or its last n rows."""
    return f"({SERIES})" if n is None else f"({SERIES} ROWS {n - 1} PRECEDING)"


def roll(fn: str, x: str, n: int, least: int | None = None) -> str:
    """fn(x) over the last n rows with a guard; fn may hold {x} for calls with more arguments."""
    call = fn.format(x=x) if "{x}" in fn else f"{fn}({x})"
    return f"(CASE WHEN count({x}) OVER {over(n)} >= {n if least is None else least} THEN {call} OVER {over(n)} END)"


def roll2(fn: str, y: str, x: str, n: int, least: int | None = None) -> str:
    return f"(CASE WHEN count(CASE WHEN {y} IS NOT NULL AND {x} IS NOT NULL THEN 1 END) OVER {over(n)} >= {n if least is None else least} THEN {fn}({y}, {x}) OVER {over(n)} END)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {over()}"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER {over()}"


def div(x: str, y: str) -> str:
    return f"(({x}) / nullif({y}, 0))"


def change(x: str = "close", k: int = 1) -> str:
    return f"({div(x, lag(x, k))} - 1)"


def clip(x: str, low: float, high: float) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, {high}), {low}) END)"


def zscore(x: str, n: int, least: int | None = None) -> str:
    k = n // 2 if least is None else least
    std = roll("stddev_samp", x, n, k)
    return f"(({x} - {roll('avg', x, n, k)}) / (CASE WHEN {std} > 1e-6 THEN {std} ELSE 1e-6 END))"


def avg_rank(x: str, by: str = "eob") -> str:
    return (
        f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) "
        f"+ (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END)"
    )


def pct_rank(x: str, by: str = "eob") -> str:
    return f"({avg_rank(x, by)} / count({x}) OVER (PARTITION BY {by}))"


POSITIVE_LOG = "(CASE WHEN {0} > 0 THEN ln({0}) END)"


def log(x: str) -> str:
    return POSITIVE_LOG.format(x)


def steps(source: str, *stages: dict[str, str], select: str, tail: str = "", start: str = "bars") -> str:
    """Chained CTEs that add columns stage by stage, then a final select."""
    text, last = [source.strip()], start
    for i, stage in enumerate(stages):
        text.append(f"s{i} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {last})")
        last = f"s{i}"
    return f"WITH RECURSIVE {', '.join(text)} SELECT {select} FROM {last} {tail}"
