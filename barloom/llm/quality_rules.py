"""Quality rules: fixed limits on word statistics, then robust multivariate outliers within language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.llm.common import Scratch, mix, slices, small_batches, utf8
from barloom.llm.terms import NOT_BLANK, word_codes

#: Bytes of text turned into arrays at once.
TEXT_BYTES = 1 << 20
BLANKS = " \t\n\v\f\r"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

#: The transformed statistics, and the spread below which a difference in one of them counts for nothing special:
#: its square is added to the estimated variance, so that a statistic that hardly varies does not turn one symbol into an outlier.
STATISTICS = ("log_words", "log_word_length", "root_symbol_rate", "repeat_share", "dup_share")
LEAST_SPREAD = (0.25, 0.06, 0.08, 0.10, 0.06)
D = len(STATISTICS)
#: Rows that a group of its own must have; smaller sources of a language stand together, then smaller languages.
LEAST_ROWS = 50
#: Concentration steps at most, and the change of the log determinants below which they end.
STEPS, SETTLED = 12, 1e-4
#: Squared distances are told apart in steps of 1/64 of an octave; the step in which the h-th row lies counts in part.
STEPS_PER_OCTAVE = 64
#: A row is rejected if a Gaussian row lay so far out with this chance. Word statistics have long tails, so it is small.
TAIL = 1e-9

STATS = "doc_id long, row_ long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


# ---- statistics of texts


def repeated_words(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the number of its words that lie in a 3-word window which the text holds twice or more; words are given as codes."""
    rows = len(first) - 1
    covered = np.zeros(len(codes) + 2, bool)
    if len(codes) > 2:
        row = np.repeat(np.arange(rows), np.diff(first))
        at = np.flatnonzero(row[:-2] == row[2:])
        a, b, c = (codes[at + k].astype(np.uint64) for k in range(3))
        window = mix(mix(mix(a) + b) + c) ^ mix(row[at].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        often = np.zeros(len(at), bool)
        often[order[1:][same]] = often[order[:-1][same]] = True
        for k in range(3):
            covered[at[often] + k] = True
    return np.diff(np.concatenate([[0], np.cumsum(covered[: len(codes)])])[first])


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def word_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in STATS.split(", ")]
    for batch in batches:
        for part in slices(batch, "text", TEXT_BYTES):
            codes, _, first = word_codes(part.column("text"), NOT_BLANK, lower=False)
            data, offsets = utf8(part.column("text"))
            sums = lambda marks, offsets=offsets: np.diff(np.concatenate([[0], np.cumsum(marks)])[offsets])
            counts = [np.diff(first), sums(NOT_BLANK[data] & (data & 0xC0 != 0x80)), sums(_SYMBOL[data])]
            texts = part.column("text").to_pylist()
            counts += [np.fromiter((repeated_lines(x or "") for x in texts), np.int64, len(texts)), repeated_words(codes, first)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:4]), *(pa.array(x.astype(np.int64)) for x in counts)], names)


def transformed() -> list[Column]:
    """The statistic vector of a row: logarithms of counts, and shares whose denominators are held off zero."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n),
        F.log((F.col("word_chars") + 1) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.col("n_repeat_words") / (n + 20),
        F.col("n_dup_lines") / (n / 20 + 5),
    ]


# ---- minimum covariance determinant, all groups side by side


def chi2_cdf(x: float, freedom: int) -> float:
    """Of an odd number of degrees of freedom, in closed form."""
    term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 0.0
    for k in range(1, freedom, 2):
        total += term
        term *= x / (k + 2)
    return math.erf(math.sqrt(x / 2)) - total


def chi2_quantile(upper: float, freedom: int) -> float:
    """The value that is exceeded with chance `upper`, by bisection."""
    low, high = 0.0, 400.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - chi2_cdf(middle, freedom) > upper else (low, middle)
    return (low + high) / 2


def consistency(share: float) -> float:
    """What the covariance of the `share` nearest rows is multiplied by to be that of all, for Gaussian rows."""
    return share / chi2_cdf(chi2_quantile(1 - share, D), D + 2)


MATRIX = "log_det double, " + ", ".join([f"c{i} double" for i in range(D)] + [f"p{i}{j} double" for i, j in PAIRS])


def estimates(scale: float):
    """Per row of weighted moment sums around an old centre: the new centre, and the inverse and log determinant of the covariance times `scale` plus the least spreads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda name, batch=batch: batch.column(name).to_numpy(zero_copy_only=False)
            w = read("w")
            shift = np.stack([read(f"s{i}") for i in range(D)], 1) / w[:, None]
            cov = np.zeros((batch.num_rows, D, D))
            for i, j in PAIRS:
                cov[:, i, j] = cov[:, j, i] = read(f"m{i}{j}") / w - shift[:, i] * shift[:, j]
            cov = cov * scale + np.diag(np.square(LEAST_SPREAD))
            inverse, (_, logs) = np.linalg.inv(cov), np.linalg.slogdet(cov)
            out = [batch.column("lang"), batch.column("source"), batch.column("start"), pa.array(logs)]
            out += [pa.array(read(f"c{i}") + shift[:, i]) for i in range(D)] + [pa.array(inverse[:, i, j]) for i, j in PAIRS]
            yield pa.RecordBatch.from_arrays(out, ["lang", "source", "start", *(x.split()[0] for x in MATRIX.split(", "))])

    return run


def distance() -> Column:
    """The squared Mahalanobis distance of a row from the centre beside it."""
    out = F.lit(0.0)
    for i, j in PAIRS:
        out = out + (1 if i == j else 2) * F.col(f"p{i}{j}") * (F.col(f"x{i}") - F.col(f"c{i}")) * (F.col(f"x{j}") - F.col(f"c{j}"))
    return out


def moments() -> list[Column]:
    """Sums of a row's differences from the centre beside it, and of their products."""
    off = [F.col(f"x{i}") - F.col(f"c{i}") for i in range(D)]
    return [F.count("*").cast("double").alias("w"), *(F.sum(off[i]).alias(f"s{i}") for i in range(D)), *(F.sum(off[i] * off[j]).alias(f"m{i}{j}") for i, j in PAIRS)]


SUMS = ["w", *(f"s{i}" for i in range(D)), *(f"m{i}{j}" for i, j in PAIRS)]


def centre() -> list[Column]:
    """The centre beside the rows of a group, which is the same for all of them."""
    return [F.first(f"c{i}").alias(f"c{i}") for i in range(D)]


def medians(rows: DataFrame) -> DataFrame:
    """The median and the median absolute deviation of each statistic of each group, in steps of 1/256, from counts."""

    def middle(values: DataFrame) -> DataFrame:
        counts = values.groupBy("lang", "source", "dim", F.floor(F.col("v") * 256).alias("step")).agg(F.count("*").alias("n"))
        own = W.partitionBy("lang", "source", "dim")
        counts = counts.withColumn("upto", F.sum("n").over(own.orderBy("step"))).withColumn("all", F.sum("n").over(own))
        return counts.where(F.col("upto") * 2 >= F.col("all")).groupBy("lang", "source", "dim").agg((F.min("step") / 256).alias("median"))

    long = rows.select("lang", "source", F.posexplode(F.array(*(f"x{i}" for i in range(D)))).alias("dim", "v"))
    middles = middle(long)
    off = long.join(middles, ["lang", "source", "dim"]).select("lang", "source", "dim", F.abs(F.col("v") - F.col("median")).alias("v"))
    return middles.join(middle(off).withColumnRenamed("median", "deviation"), ["lang", "source", "dim"])


def first_estimates(rows: DataFrame, t: Scratch) -> DataFrame:
    """Two starts for each group: medians with the deviations alone, and with the correlations of bounded scores."""
    spread = t.keep("medians", medians(rows).select("lang", "source", "dim", "median", F.sqrt(F.pow(1.4826 * F.col("deviation"), 2) + F.element_at(F.array(*map(F.lit, LEAST_SPREAD)), F.col("dim") + 1) ** 2).alias("spread")))
    at = lambda name, i: F.max(F.when(F.col("dim") == i, F.col(name)))
    scale = t.small("scale", spread.groupBy("lang", "source").agg(*(at("median", i).alias(f"c{i}") for i in range(D)), *(at("spread", i).alias(f"d{i}") for i in range(D))))
    score = [F.tanh((F.col(f"x{i}") - F.col(f"c{i}")) / F.col(f"d{i}")) for i in range(D)]
    both = rows.join(scale, ["lang", "source"]).groupBy("lang", "source", *(f"c{i}" for i in range(D)), *(f"d{i}" for i in range(D))).agg(*(F.sum(score[i] * score[j]).alias(f"t{i}{j}") for i, j in PAIRS), F.count("*").alias("n"))
    share = lambda i, j: F.coalesce(F.try_divide(F.col(f"t{i}{j}"), F.sqrt(F.col(f"t{i}{i}") * F.col(f"t{j}{j}"))), F.lit(0.0)) if i != j else F.lit(1.0)
    sums = lambda start: both.select(
        "lang", "source", F.lit(start).alias("start"), *(f"c{i}" for i in range(D)), F.lit(1.0).alias("w"), *(F.lit(0.0).alias(f"s{i}") for i in range(D)),
        *((share(i, j) * F.col(f"d{i}") * F.col(f"d{j}") if start or i == j else F.lit(0.0)).alias(f"m{i}{j}") for i, j in PAIRS),
    )
    return sums(0).unionByName(sums(1)).mapInArrow(estimates(1.0), f"lang string, source string, start int, {MATRIX}")


def concentrated(rows: DataFrame, now: DataFrame, share: float) -> DataFrame:
    """One concentration step: of each group and start, the moments of the `share` of the rows nearest to the centre.

    Rows are summed by step of the distance, so a group of any size is a bounded number of partial sums; the
    step in which the last row lies counts with the part of it that is still needed.
    """
    step = F.floor(F.log2(distance() + 1e-6) * STEPS_PER_OCTAVE)
    sums = rows.join(now, ["lang", "source"]).groupBy("lang", "source", "start", step.alias("step")).agg(*moments(), *centre())
    own = W.partitionBy("lang", "source", "start")
    sums = sums.withColumn("upto", F.sum("w").over(own.orderBy("step"))).withColumn("need", F.ceil(F.sum("w").over(own) * share))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("need") - F.col("upto") + F.col("w")) / F.col("w")))
    sums = sums.withColumn("part", part).where("part > 0").groupBy("lang", "source", "start").agg(*(F.sum(F.col(c) * F.col("part")).alias(c) for c in SUMS), *centre())
    return sums.mapInArrow(estimates(consistency(share)), f"lang string, source string, start int, {MATRIX}")


def robust_estimates(rows: DataFrame, t: Scratch, share: float) -> DataFrame:
    """The centre and inverse covariance of each group (lang, source) of rows x0.. by the minimum covariance determinant.

    Two starts are concentrated until no log determinant changes; the lesser determinant is kept and
    estimated once more from all rows within the 97.5 % distance. One row a group, of a few dozen numbers.
    """
    now = t.small("estimate_0", first_estimates(rows, t))
    for k in range(1, STEPS + 1):
        new = t.small(f"estimate_{k}", concentrated(rows, now, share))
        old = now.select("lang", "source", "start", F.col("log_det").alias("before"))
        change = new.join(old, ["lang", "source", "start"]).agg(F.max(F.abs(F.col("log_det") - F.col("before")))).first()[0]
        now = new
        if change is None or (k > 1 and change < SETTLED):
            break
    best = now.withColumn("place", F.row_number().over(W.partitionBy("lang", "source").orderBy("log_det", "start"))).where("place = 1").drop("place")
    best = t.small("best", best)
    near = rows.join(best, ["lang", "source"]).where(distance() <= chi2_quantile(0.025, D)).groupBy("lang", "source", "start").agg(*moments(), *centre())
    return t.small("estimate", near.mapInArrow(estimates(consistency(0.975)), f"lang string, source string, start int, {MATRIX}"))


def judge(documents: DataFrame, share: float = 0.5, tail: float = TAIL) -> DataFrame:
    """Word statistics of every whole text, the verdict of the fixed limits, and that of the robust distance.

    Words are runs of other than blanks. A text fails the limits with fewer than 50 words, or when more than half of
    its words lie in 3-word windows that it repeats. Each (lang, source) has a centre and covariance of its
    transformed statistics by the minimum covariance determinant over all its texts that pass the limits
    (`share`: the part of the rows that the least determinant is sought over); a text goes if its squared
    Mahalanobis distance has a chance under `tail`. Sources with fewer than LEAST_ROWS such texts are
    estimated together with the other small ones of their language, small languages with each other; if
    those are still fewer, the limits alone decide.

    Null texts have no words and fail the limits; null lang and source are groups of their own with ''. Rows that
    repeat count each; a null doc_id is kept. An empty table gives no rows; other columns are ignored.
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(
        F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row_"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")),
    )
    with Scratch(spark) as t:
        base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        stats = t.keep("stats", rows.mapInArrow(word_statistics, STATS).withColumn("base_failed", base).withColumns({f"x{i}": c for i, c in enumerate(transformed())}))
        sizes = stats.where("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
        lone = F.col("n") >= LEAST_ROWS
        # \u0001 cannot be met in the names of small groups alone: names that hold it are only kept apart less finely
        sizes = sizes.withColumn("g_source", F.when(lone, F.col("source")).otherwise("\u0001small"))
        many = F.sum(F.when(~lone, F.col("n")).otherwise(0)).over(W.partitionBy("lang")) >= LEAST_ROWS
        sizes = sizes.withColumn("g_lang", F.when(lone | many, F.col("lang")).otherwise("\u0001small"))
        groups = t.small("groups", sizes.select("lang", "source", "g_lang", "g_source"))
        passed = stats.where("NOT base_failed").join(groups, ["lang", "source"])
        vectors = t.keep("vectors", passed.select(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), *(f"x{i}" for i in range(D))))
        enough = vectors.groupBy("lang", "source").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS).select("lang", "source")
        vectors = vectors.join(t.small("enough", enough), ["lang", "source"])
        final = robust_estimates(vectors, t, share).withColumnsRenamed({"lang": "g_lang", "source": "g_source"}).drop("start", "log_det")
    far = stats.join(groups, ["lang", "source"], "left").join(final, ["g_lang", "g_source"], "left")
    far = far.withColumn("distance", F.when(~F.col("base_failed"), distance()))
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= chi2_quantile(tail, D)))
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
