"""Checks of panels and of what is computed from them: rules of a panel, content hashes, causality by prefixes, alignment of outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HARD, SOFT, INFO = "hard_fail", "soft_fail", "info"
FINDINGS = "code string, passed boolean, severity string, detail string"

# ---- levels and rules of a panel


def identify_levels(df: DataFrame, symbol: str = "symbol", at: str | None = None) -> tuple[str, str]:
    """The columns that name a row's series and its time: `symbol`, and `at` or else the only date or timestamp column.

    Raises ValueError if one is missing, ambiguous, or both are the same.
    """
    names = [f.name for f in df.schema.fields]
    if names.count(symbol) != 1:
        raise ValueError(f"there must be one column {symbol!r}: {names}")
    timed = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    found = [n for n in timed if n == at] if at is not None else timed
    if len(found) != 1:
        raise ValueError(f"the time column is missing or ambiguous: {found or timed}")
    if found[0] == symbol:
        raise ValueError("symbol and time are one column")
    return symbol, found[0]


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def panel_facts(df: DataFrame, required: tuple[str, ...], symbol: str, at: str) -> DataFrame:
    """One row of counts over a panel, from one aggregation by key and one over the keys: rows, symbols, repeated keys, bad names, cells of each required field, bars that contradict themselves."""
    numbers = [c for c in required if c in df.columns and is_number(df.schema[c].dataType)]
    bars = {c for c in ("open", "high", "low", "close") if c in df.columns and is_number(df.schema[c].dataType)}
    broken = F.lit(0)
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    if {"high", "low"} <= bars:
        broken = broken + flag(F.col("high") < F.col("low"))
    if {"high", "open", "close"} <= bars:
        broken = broken + flag(F.col("high") < F.greatest("open", "close"))
    if {"low", "open", "close"} <= bars:
        broken = broken + flag(F.col("low") > F.least("open", "close"))
    cells = [F.sum(e.cast("long")).alias(f"{k}_{c}") for c in numbers for k, e in (
        ("finite", finite(F.col(c).cast("double"))), ("missing", F.col(c).isNull() | F.isnan(F.col(c).cast("double"))), ("inf", F.coalesce(F.abs(F.col(c).cast("double")) == float("inf"), F.lit(False))),
    )]
    keys = df.groupBy(F.col(symbol).cast("string").alias("symbol"), F.col(at).alias("at")).agg(F.count("*").alias("n"), F.sum(broken).alias("broken"), *cells)
    # the counts of a symbol first, so that the number of symbols comes without a distinct over all rows
    per = keys.groupBy("symbol").agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeated"), F.max((F.col("n") > 1).cast("int")).alias("unsorted"), F.sum(F.when(F.col("at").isNull(), F.col("n")).otherwise(0)).alias("timeless"), F.sum("broken").alias("broken"), *[F.sum(f"{k}_{c}").alias(f"{k}_{c}") for c in numbers for k in ("finite", "missing", "inf")])
    blank = F.coalesce(F.trim("symbol") == "", F.lit(True))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return per.agg(F.count("*").alias("symbols"), F.coalesce(F.sum(F.when(blank, F.col("rows"))), F.lit(0)).alias("nameless"), *[zero(c) for c in ("rows", "repeated", "unsorted", "timeless", "broken")], *[zero(f"{k}_{c}") for c in numbers for k in ("finite", "missing", "inf")])


def validate_panel(df: DataFrame, required: tuple[str, ...] = (), symbol: str = "symbol", at: str | None = None, allowed: tuple[str, ...] | None = None, universe: tuple[str, ...] = (), least_coverage: float | None = None) -> DataFrame:
    """Findings on a panel as rows: code, passed, severity, detail. One rule, one row; the last says whether no hard rule failed.

    Rules that the columns decide are told from the schema; all others come from one aggregation over the
    panel's keys. The panel is not changed.
    """
    spark, fixed = df.sparkSession, []
    say = lambda code, passed, severity, detail="": fixed.append((code, passed, INFO if passed else severity, str(detail)))
    try:
        symbol, at = identify_levels(df, symbol, at)
    except ValueError as error:
        return spark.createDataFrame([("levels", False, HARD, str(error)), ("panel", False, INFO, "")], FINDINGS)
    say("levels", True, HARD, f"{symbol}, {at}")
    say("symbol_type", isinstance(df.schema[symbol].dataType, T.StringType), HARD, df.schema[symbol].dataType.simpleString())
    absent = [c for c in required if c not in df.columns]
    say("required_fields", not absent, HARD, ",".join(absent))
    if allowed is not None:
        outside = [c for c in required if c not in allowed]
        say("allowed_fields", not outside, HARD, ",".join(outside))
    for c in required:
        if c in df.columns and not is_number(df.schema[c].dataType):
            say(f"numeric:{c}", False, HARD, df.schema[c].dataType.simpleString())
    numbers = [c for c in required if c in df.columns and is_number(df.schema[c].dataType)]
    finding = lambda code, bad, severity: F.struct(F.lit(code).alias("code"), (bad == 0).alias("passed"), F.when(bad == 0, INFO).otherwise(severity).alias("severity"), bad.cast("string").alias("detail"))
    found = [finding("symbol_names", F.col("nameless"), HARD), finding("times", F.col("timeless"), HARD), finding("unique_keys", F.col("repeated"), HARD), finding("symbol_times", F.col("unsorted"), HARD), finding("bars", F.col("broken"), SOFT)]
    found += [finding(f"infinite:{c}", F.col(f"inf_{c}"), SOFT) for c in numbers]
    share = {c: F.coalesce(F.try_divide(F.col(f"finite_{c}"), F.col("rows")), F.lit(0.0)) for c in numbers}
    told = lambda code, passed, detail, severity: F.struct(F.lit(code).alias("code"), passed.alias("passed"), F.when(passed, INFO).otherwise(severity).alias("severity"), detail.cast("string").alias("detail"))
    found += [told(f"coverage:{c}", F.lit(True), F.round(s, 6), SOFT) for c, s in share.items()]
    if share:
        worst = F.least(*share.values()) if len(share) > 1 else next(iter(share.values()))
        found.append(told("coverage", worst >= (least_coverage or 0.0), F.round(worst, 6), SOFT))
    rows = panel_facts(df, required, symbol, at).select(F.explode(F.array(*found)).alias("f")).select("f.*")
    if universe:
        strange = df.select(F.col(symbol).cast("string").alias("s")).distinct().where(~F.col("s").isin(*universe) | F.col("s").isNull()).agg(F.count("*").alias("n"))
        rows = rows.unionByName(strange.select(told("universe", F.col("n") == 0, F.col("n"), HARD).alias("f")).select("f.*"))
    rows = rows.unionByName(spark.createDataFrame(fixed, FINDINGS))
    whole = rows.agg((F.sum((~F.col("passed") & (F.col("severity") == HARD)).cast("int")) == 0).alias("passed"))
    return rows.unionByName(whole.select(F.lit("panel").alias("code"), "passed", F.lit(INFO).alias("severity"), F.lit("").alias("detail")))


def normalized(df: DataFrame, required: tuple[str, ...] = (), symbol: str = "symbol", at: str | None = None) -> DataFrame:
    """The panel with its levels as `symbol` (text) and `eob` (timestamp without zone), and the required fields as doubles.

    Raises ValueError if a level or field is missing or not a number. Other columns stay as they are.
    """
    symbol, at = identify_levels(df, symbol, at)
    for c in required:
        if c not in df.columns or not is_number(df.schema[c].dataType):
            raise ValueError(f"field {c!r} is missing or not a number")
    rest = [F.col(c).cast("double").alias(c) if c in required else F.col(c) for c in df.columns if c not in (symbol, at)]
    return df.select(F.col(symbol).cast("string").alias("symbol"), F.col(at).cast("timestamp_ntz").alias("eob"), *rest)


def restored(values: DataFrame, df: DataFrame, symbol: str = "symbol", at: str | None = None, value: str = "value") -> DataFrame:
    """Every row of the original panel with the value that was computed for its (symbol, eob); a value for no row of it is left out."""
    symbol, at = identify_levels(df, symbol, at)
    keyed = values.select(F.col("symbol").alias("k_"), F.col("eob").alias("e_"), F.col(value).cast("double").alias("v_"))
    met = (df[symbol].cast("string") == keyed["k_"]) & (df[at].cast("timestamp_ntz") == keyed["e_"])
    return df.join(keyed, met, "left").select(*[df[c] for c in df.columns], F.col("v_").alias(value))


# ---- content


def content_hash(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A digest of a table's rows (of each group `by`): rows, digest. The order of rows and their partitions do not matter; any changed, lost or repeated row does.

    Each row is hashed twice with its columns in the order of their names and their types beside them; hashes are added
    up in 128-bit numbers, so parts of a table add up to the whole. NaN is a value of its own, -0.0 is 0.0, a null
    is told from an empty text.
    """
    names = sorted(c for c in df.columns if c not in by)
    cells = [F.struct(F.lit(f"{c}:{df.schema[c].dataType.simpleString()}"), F.col(c).isNull(), F.col(c)) for c in names]
    halves = [F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)") for seed in (11, 29)]
    sums = df.select(*by, *[h.alias(f"h{i}_") for i, h in enumerate(halves)]).groupBy(*by).agg(F.count("*").alias("rows"), *[F.sum(f"h{i}_").alias(f"h{i}_") for i in range(2)])
    text = F.concat_ws("|", F.lit(",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in names)), F.col("rows").cast("string"), *[F.coalesce(F.col(f"h{i}_"), F.lit(0)).cast("string") for i in range(2)])
    return sums.select(*by, "rows", F.sha2(text, 256).alias("digest"))


def to_payload(df: DataFrame, value: str = "value") -> DataFrame:
    """Each symbol's series as one JSON text: symbol, payload. Values that JSON has no number for are named (nan, inf, -inf)."""
    x = F.col(value).cast("double")
    text = F.when(x.isNull(), F.lit(None).cast("string")).when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(x.cast("string"))
    cells = F.sort_array(F.collect_list(F.struct(F.date_format("eob", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("eob"), text.alias("value"))))
    return df.groupBy("symbol").agg(F.to_json(cells, {"ignoreNullFields": "false"}).alias("payload"))


def from_payload(payloads: DataFrame, value: str = "value") -> DataFrame:
    """The rows (symbol, eob, value) of what `to_payload` wrote."""
    cells = F.explode(F.from_json("payload", "array<struct<eob:string,value:string>>")).alias("c")
    x = F.col("c.value")
    number = F.when(x == "nan", float("nan")).when(x == "inf", float("inf")).when(x == "-inf", float("-inf")).otherwise(x.cast("double"))
    return payloads.select("symbol", cells).select("symbol", F.col("c.eob").cast("timestamp_ntz").alias("eob"), number.alias(value))


# ---- causality

#: Four hundred years have the same days of the week, month and year; shifted by them, prefixes keep their calendar and share no date.
CYCLE_DAYS = 146_097
#: Most prefixes that one job computes, so that shifted dates stay within what a timestamp holds.
MOST_CUTS = 600


def prefix_causality(df: DataFrame, compute: Callable[[DataFrame], DataFrame], value: str = "value", cuts: list | None = None, least: int = 4, tolerance: float = 0.0) -> DataFrame:
    """Whether rows to come change a computed value: of each cut the rows up to it, those whose value differs from that over the whole panel, and the first such date.

    `compute` gives symbol, eob and `value`, and may use windows by symbol and by date. The panel is
    unfolded into its prefixes, each with symbols and dates of its own (dates are shifted by whole calendar cycles),
    so one run of the plan computes all of them. cuts: dates; None: every date but the last, from the `least`-th on,
    which costs the square of the number of dates. Returns cut, rows, changed, first_changed, passed.
    """
    days = [r["eob"] for r in df.select("eob").distinct().orderBy("eob").collect()] if cuts is None else sorted(cuts)  # one value a date
    chosen = days[least - 1 : -1] if cuts is None else days
    kind, out = dict(df.dtypes)["eob"], None
    whole = compute(df).select("symbol", "eob", F.col(value).alias("whole_"))
    for begin in range(0, len(chosen), MOST_CUTS):
        own = chosen[begin : begin + MOST_CUTS]
        table = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(c).cast(kind).alias("cut")) for i, c in enumerate(own)])
        shift = lambda at, sign: F.expr(f"CAST({at} AS TIMESTAMP_NTZ) {sign} make_dt_interval(i_ * {CYCLE_DAYS})").cast(kind)
        parts = df.withColumn("c_", F.explode(F.filter(table, lambda c: F.col("eob") <= c["cut"]))).withColumns({"i_": F.col("c_.i")})
        parts = parts.withColumns({"symbol": F.concat_ws("\u0001", F.col("i_").cast("string"), "symbol"), "eob": shift("eob", "+")}).drop("c_", "i_")
        again = compute(parts).select("symbol", "eob", F.col(value).alias("again_"))
        name = F.split("symbol", "\u0001", 2)
        again = again.withColumns({"i_": name[0].cast("int"), "symbol": name[1]}).withColumn("eob", shift("eob", "-"))
        expected = whole.withColumn("c_", F.explode(F.filter(table, lambda c: F.col("eob") <= c["cut"]))).select("symbol", "eob", "whole_", F.col("c_.i").alias("i_"), F.lit(True).alias("there_"))
        both = expected.join(again.withColumn("had_", F.lit(True)), ["i_", "symbol", "eob"], "full")
        same = F.col("there_").isNotNull() & F.col("had_").isNotNull() & (F.col("whole_").eqNullSafe(F.col("again_")) | F.coalesce(F.abs(F.col("whole_") - F.col("again_")) <= tolerance, F.lit(False)))
        found = both.groupBy("i_").agg(F.count("*").alias("rows"), F.sum((~same).cast("long")).alias("changed"), F.min(F.when(~same, F.col("eob"))).alias("first_changed"))
        found = found.withColumn("cut", F.element_at(table, F.col("i_"))["cut"]).select("cut", "rows", "changed", "first_changed", (F.col("changed") == 0).alias("passed"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("too few dates for a prefix")
    return out


def alignment(df: DataFrame, values: DataFrame, value: str = "value", valid: str | None = None, warmup: int | None = None, missing: str = "keep_nan") -> DataFrame:
    """Findings on computed values beside their panel: keys repeated, lost or added, infinite values, a flag that disagrees, a warm-up that is too long, holes behind it.

    `valid`: a boolean column of the values. missing: keep_nan (holes are told, softly) or drop_nan (there may be none
    behind the warm-up). Both sides meet in one join by key; the order within a symbol is one window.
    """
    if missing not in ("keep_nan", "drop_nan"):
        raise ValueError(f"unknown policy: {missing}")
    if not is_number(values.schema[value].dataType):
        raise ValueError(f"values are not numbers: {values.schema[value].dataType.simpleString()}")
    left = df.groupBy("symbol", "eob").agg(F.count("*").alias("l_"))
    flag = F.max(valid) if valid else F.lit(None).cast("boolean")
    right = values.groupBy("symbol", "eob").agg(F.count("*").alias("r_"), F.max(F.col(value).cast("double")).alias("v_"), flag.alias("f_"))
    rows = left.join(right, ["symbol", "eob"], "full").withColumn("ok_", F.coalesce(finite(F.col("v_")), F.lit(False)))
    own = Window.partitionBy("symbol").orderBy("eob")
    begun = F.max("ok_").over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"begun_": begun, "inf_": F.coalesce(F.abs("v_") == float("inf"), F.lit(False))})
    leading = rows.groupBy("symbol").agg(
        F.sum((~F.col("begun_")).cast("long")).alias("lead"), F.sum((F.col("begun_") & ~F.col("ok_")).cast("long")).alias("holes"), F.sum(F.greatest(F.coalesce("l_", F.lit(0)), F.coalesce("r_", F.lit(0))) - 1).alias("repeated"),
        F.sum(F.col("r_").isNull().cast("long")).alias("lost"), F.sum(F.col("l_").isNull().cast("long")).alias("added"), F.sum(F.col("inf_").cast("long")).alias("inf"),
        F.sum((F.col("f_").isNull() | (F.col("f_") != F.col("ok_"))).cast("long")).alias("disagree"),
    )
    total = leading.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("repeated", "lost", "added", "inf", "disagree", "holes")], F.coalesce(F.max("lead"), F.lit(0)).alias("lead"))
    rules = [("duplicate_keys", F.col("repeated"), HARD), ("keys", F.col("lost") + F.col("added"), HARD), ("infinite", F.col("inf"), HARD)]
    rules += [("valid_flag", F.col("disagree"), HARD)] if valid else []
    rules += [("warmup", F.greatest(F.col("lead") - warmup, F.lit(0)), HARD)] if warmup is not None else []
    rules += [("holes", F.col("holes"), SOFT if missing == "keep_nan" else HARD)]
    found = [F.struct(F.lit(c).alias("code"), (n == 0).alias("passed"), F.when(n == 0, INFO).otherwise(s).alias("severity"), n.cast("string").alias("detail")) for c, n, s in rules]
    return total.select(F.explode(F.array(*found)).alias("f")).select("f.*")
