"""How the sources of a language differ in their terms: dense group-by-term tiles, summed pair matrices, merged heaps."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.llm.common import Scratch, slices, small_batches
from barloom.llm.terms import LETTERS, word_codes

#: Bytes of text counted at once, rows of (group, term) that a task holds before it sums them and, if they stay many, hands them on, a batch of GIVEN_ROWS at a time.
TEXT_BYTES, HELD_TERMS, GIVEN_ROWS = 4 << 20, 1_000_000, 50_000
#: A term block has at least so many terms, and TERMS_PER_GROUP for each group of its language, so that all partial
#: pair matrices together hold no more than an eighth of the numbers in the tiles. A tile has at most TILE numbers.
BLOCK_TERMS, TERMS_PER_GROUP, TILE = 2048, 8, 1 << 22
#: Differences that are computed at once when a block's pairs are broadcast.
BROADCAST_CELLS = 1 << 20
#: Blocks whose heaps are merged at once.
HEAPS = 64
SCALE = 1_000_000_000

COUNTED = "lang string, source string, term string, n long, docs long"
PARTS = "lang string, source string, part string, item string, value long, block int"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every (lang, source, term), summed over a task's rows as far as they are held."""
    numbers: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        found = pa.concat_tables(held).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        held.clear()
        return found

    def given(found: pa.Table) -> Iterator[pa.RecordBatch]:
        names = [pa.array(c, pa.string()) for c in zip(*numbers, strict=True)]
        for part in found.to_batches(max_chunksize=GIVEN_ROWS):
            sides = [n.take(part.column("group")) for n in names]
            yield pa.RecordBatch.from_arrays([*sides, *(part.column(c) for c in ("term", "n_sum", "docs_sum"))], [x.split()[0] for x in COUNTED.split(", ")])

    for batch in batches:
        for part in slices(batch, "text", TEXT_BYTES):
            codes, words, first = word_codes(part.column("text"), LETTERS, lower=True)
            if not len(codes):
                continue
            names = zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)
            group = np.fromiter((numbers.setdefault(g, len(numbers)) for g in names), np.int64, part.num_rows)
            row, wide = np.repeat(np.arange(part.num_rows), np.diff(first)), len(words)
            # once for each (row, term), with its occurrences; then once for each (group, term)
            pairs, times = np.unique(row * wide + codes, return_counts=True)
            keys, where = np.unique(group[pairs // wide] * wide + pairs % wide, return_inverse=True)
            sums = np.bincount(where, weights=times, minlength=len(keys)).astype(np.int64)  # far below 2 ** 53
            columns = [pa.array(keys // wide, pa.int32()), words.cast(pa.string()).take(pa.array(keys % wide)), pa.array(sums), pa.array(np.bincount(where, minlength=len(keys)).astype(np.int64))]
            held.append(pa.Table.from_arrays(columns, ["group", "term", "n", "docs"]))
            if sum(t.num_rows for t in held) >= HELD_TERMS:
                found = summed()
                if found.num_rows > HELD_TERMS // 2:
                    yield from given(found)
                else:
                    held.append(found.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["group", "term", "n", "docs"]))
    if held:
        yield from given(summed())


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + kept)) in int64, exact for totals to 9e15: three digits of SCALE at a time."""
    above, below = counts + 1, total + kept
    out, rest = np.divmod(above, below)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digits
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q), elementwise in int64; p and q are at most SCALE + 1."""
    return (p - q) ** 2 // q


def pair_matrix(p: np.ndarray) -> np.ndarray:
    """[i, j]: the distances of group i from group j, summed over the tile's terms; all pairs are broadcast, some terms or groups at a time."""
    groups, terms = p.shape
    out = np.zeros((groups, groups), np.int64)
    width = max(1, min(terms, BROADCAST_CELLS // groups))
    rows = max(1, BROADCAST_CELLS // (groups * width))
    for a in range(0, terms, width):
        tile = p[:, a : a + width]
        for i in range(0, groups, rows):
            out[i : i + rows] += distances(tile[i : i + rows, None, :], tile[None, :, :]).sum(axis=2)
    return out


def audit_block(most: int):
    """For one term block of a language: its partial pair matrix, and for each group a heap of its `most` foremost terms."""

    def run(counts: pa.Table, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("source")
        lang, block = groups.column("lang")[0].as_py(), groups.column("block")[0].as_py()
        kept, all_words = groups.column("kept")[0].as_py(), groups.column("lang_words")[0].as_py()
        sources, words = groups.column("source").to_pylist(), groups.column("words").to_numpy()
        terms = counts.column("term").combine_chunks().dictionary_encode() if counts.num_rows else pa.array([], pa.string()).dictionary_encode()
        if isinstance(terms, pa.ChunkedArray):
            terms = terms.combine_chunks()
        names = terms.dictionary.to_pylist()
        tile, own = np.zeros((len(sources), len(names)), np.int64), np.zeros(len(names), np.int64)
        if names:
            number = {s: k for k, s in enumerate(sources)}
            at = np.fromiter((number[s] for s in counts.column("source").to_pylist()), np.int64, counts.num_rows)
            codes = terms.indices.to_numpy(zero_copy_only=False)
            tile[at, codes] = counts.column("n").to_numpy()
            own[codes] = counts.column("lang_n").to_numpy()
        p = shares(tile, words[:, None], kept) if kept else tile
        out = []
        pairs = pair_matrix(p) if names else np.zeros((len(sources),) * 2, np.int64)
        for i, s in enumerate(sources):
            out += [(lang, s, "pair", t, int(v), block) for j, (t, v) in enumerate(zip(sources, pairs[i].tolist(), strict=True)) if j != i]
        q = shares(own, np.int64(all_words), kept) if names else own
        for i, s in enumerate(sources):
            ahead = np.flatnonzero((tile[i] > 0) & (p[i] > q)) if names else []
            if len(ahead):
                value = distances(p[i, ahead], q[ahead])
                if len(ahead) > most:  # all ties of the last place go on to be told apart by their names
                    least = np.partition(value, len(value) - most)[len(value) - most]
                    ahead, value = ahead[value >= least], value[value >= least]
                heap = heapq.nsmallest(most, zip((-value).tolist(), (names[k] for k in ahead), strict=True))
                out += [(lang, s, "term", t, -v, block) for v, t in heap]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()]
        columns = zip(*out, strict=True) if out else [[]] * 6
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PARTS.split(", ")])

    return run


def merge_heaps(most: int):
    """The foremost `most` of some heaps of one group, ranked by value, then by the bytes of the term."""

    def run(heaps: pa.Table) -> pa.Table:
        best = heapq.nsmallest(most, zip((-v for v in heaps.column("value").to_pylist()), heaps.column("item").to_pylist(), strict=True))
        same = [pa.array([heaps.column(c)[0].as_py()] * len(best), k) for c, k in (("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("upper", pa.int32()))]
        return pa.Table.from_arrays(
            [*same[:3], pa.array([t for _, t in best], pa.string()), pa.array([-v for v, _ in best], pa.int64()), same[3], pa.array(range(1, len(best) + 1), pa.int32())],
            ["lang", "source", "part", "item", "value", "upper", "rank"],
        )

    return run


def audit_sources(documents: DataFrame, least_documents: int = 3, most_terms: int = 200) -> DataFrame:
    """How far each source of a language is from each other one, and which terms it uses more than its language.

    Terms are runs of ASCII letters and of other characters, with A-Z lowered; a language keeps those in at
    least `least_documents` of its rows. A share p of a kept term in a group is 1 + floor(1e9 * (count + 1) /
    (N + V)), all in 64-bit integers. Kept terms of a language are dealt by hash into blocks; a block's
    counts become one dense group-by-term tile, whose pairs are broadcast against each other. Partial pair
    matrices are added up by (lang, source, item), and the heaps of a group are merged HEAPS blocks at a time. No
    task sees a whole language or a whole group; every (lang, source) that occurs has a row in each tile.

    Null text, lang and source are ''. Rows that repeat count each. A group without terms still stands
    against the others; a source alone in its language has no pairs. An empty table gives no rows. Other
    columns are ignored. Returns lang, source, part (`pair`: other source, all ranks; `term`: kept term, ranks to
    `most_terms`), item, value, rank from 1 by value descending, then item in the order of its bytes.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    with Scratch(spark) as t:
        # tasks hand on sums, so one exchange by (lang, term) serves the sums of a group's term and those of a language's
        counted = rows.mapInArrow(count_terms, COUNTED).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        same = W.partitionBy("lang", "term")
        kept = t.keep("kept", (
            counted.withColumn("in", F.sum("docs").over(same)).where(F.col("in") >= least_documents)
            .select("lang", "source", "term", "n", F.sum("n").over(same).alias("lang_n"), (F.row_number().over(same.orderBy("source")) == 1).alias("once"))
        ))
        words = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.sum(F.col("once").cast("long")).alias("kept"))
        groups = rows.groupBy("lang", "source").agg(F.lit(1).alias("one")).join(words, ["lang", "source"], "left")
        groups = t.keep("groups", groups.select("lang", "source", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("kept", F.lit(0)).alias("kept")))
        langs = groups.groupBy("lang").agg(F.sum("words").alias("lang_words"), F.sum("kept").alias("kept"), F.count("*").alias("of"))
        size = F.greatest(F.lit(1), F.least(F.greatest(F.lit(BLOCK_TERMS), F.col("of") * TERMS_PER_GROUP), F.floor(TILE / F.col("of"))))
        langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / size)).cast("int"))
        langs = t.small("langs", langs)
        dealt = kept.join(langs.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term", "n", "lang_n")
        each = groups.select("lang", "source", "words").join(langs, "lang").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        parts = t.keep("parts", dealt.groupBy("lang", "block").cogroup(each.select("lang", "block", "source", "words", "kept", "lang_words").groupBy("lang", "block")).applyInArrow(audit_block(most_terms), PARTS))
        t.drop("kept")
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", place.cast("int"))
    merged = "lang string, source string, part string, item string, value long, upper int, rank int"
    heaps = parts.where("part = 'term'").withColumn("upper", F.floor(F.col("block") / HEAPS).cast("int"))
    heaps = heaps.groupBy("lang", "source", "upper").applyInArrow(merge_heaps(most_terms), merged)
    heaps = heaps.groupBy("lang", "source").applyInArrow(merge_heaps(most_terms), merged)
    return pairs.unionByName(heaps.drop("upper")).select("lang", "source", "part", "item", "value", "rank")
