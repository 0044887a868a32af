"""Benchmark decontamination by spaced seeds. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch

#: Fixed masks over word positions: 1 must agree, 0 is ignored. Each weighs 5. Wherever 12 of 15 words agree one of the three
#: fits, so no overlap of 12 words is missed, nor an item of which four words in five agree; SHORT_MASKS see to the shortest.
MASKS = ("1101011", "10111001", "11111")
#: Further masks for items of so many words, where changes that leave four words in five can elude the others (items of 8, 9
#: and 11 to 14 words never do). They are laid only if the benchmark has such items.
SHORT_MASKS = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("111",), 5: ("111", "1101"), 6: ("111",), 7: ("111",), 10: ("111",)}
#: A verified overlap: this many words agree in its best stretch, or this share of the item's words there or over the whole item.
LEAST_WORDS, LEAST_SHARE = 12, 0.8
#: What a word that differs costs against one that agrees; a stretch thus agrees in 3 of 4 words at least.
MISMATCH = 3
#: Most seeds (six integers each) that are broadcast at once, with the words of the items they come from once; more items are searched
#: in further blocks. A single item of more is a block of its own.
BLOCK_SEEDS = 1_000_000
#: Words of a text that are searched at once, beside those around them that an item laid there may cover.
WINDOW_WORDS = 512
#: Most leaking ids that are broadcast to a filter; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits (an empty first or last entry where a text begins or ends otherwise)."""
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")


def windows(documents: DataFrame, most: int) -> DataFrame:
    """Texts in windows, so that no row is wide: doc_id, `words` (hashes), `start` (place of the first of them), `low`, `high`.

    Positions from `low` to `high` are a window's own; of the words around, `most` on either side come along.
    """
    size = max(WINDOW_WORDS, 2 * most)
    cut = lambda k: F.slice("w", F.greatest(k * size - most, F.lit(0)) + 1, F.lit(size + 2 * most))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int")), cut)
    rows = documents.select(F.col("doc_id").cast("long"), words(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n"), parts.alias("parts"))
    rows = rows.select("doc_id", "n", F.posexplode_outer("parts").alias("k", "part"))
    rows = rows.select("doc_id", "n", "k", F.transform("part", lambda w: F.xxhash64(w)).alias("words"), F.greatest(F.col("k") * size - most, F.lit(0)).alias("start"))
    low, high = F.col("k") * size - F.col("start"), F.least(F.col("n"), (F.col("k") + 1) * size) - 1 - F.col("start")
    return rows.select("doc_id", "words", "start", low.alias("low"), high.alias("high"))


def with_seeds(rows: DataFrame, hashes: str, low: Column, high: Column, masks: dict[str, Column]) -> DataFrame:
    """The rows once for each position from `low` to `high` (`at`) and mask, with the `seed`: the hash of the words that the mask picks there.

    `masks` has for each mask the rows that it is laid on; elsewhere, and where it would hang over the end
    of a text, the seed is null and meets nothing. Only compiled functions stand here, so Spark compiles them with the join behind and copies words for
    hits alone; outer explodes keep it from evaluating the hashes twice, for a filter of empty arrays.
    """
    laid = [F.when(there & (F.col("at") + len(mask) <= F.size(hashes)), seed_of(F.col(hashes), F.col("at"), k, mask)) for k, (mask, there) in enumerate(masks.items())]
    return rows.select("*", F.explode_outer(F.sequence(low, high)).alias("at")).select("*", F.posexplode_outer(F.array(*laid)).alias("mask", "seed"))


def seed_of(hashes: Column, at: Column, k: int, mask: str) -> Column:
    """The hash of the words that mask number `k` picks at a position."""
    return F.xxhash64(F.lit(k), *[F.get(hashes, at + o) for o, c in enumerate(mask) if c == "1"])


def first_of_run(masks: list[str]) -> Column:
    """Whether a hit is the first of a run: the same mask does not agree one word before on the same diagonal, in the same window.

    A run is verified once, so a long copy of a long item costs its length and not its square.
    """
    before = F.coalesce(*[F.when(F.col("mask") == k, seed_of(F.col("words"), F.col("at") - 1, k, m)) for k, m in enumerate(masks)])
    return (F.col("from") == 0) | (F.col("at") == F.col("low")) | (before != F.col("before"))


def overlap(item: Column, hashes: Column, shift: Column) -> Column:
    """The best stretch of the item laid on the document at `shift`: score, words that agree, its words; and `total`, all words of the item that agree."""
    zero = F.lit(0)
    start = F.struct(zero.alias("run"), zero.alias("same"), zero.alias("size"), zero.alias("score"), zero.alias("matched"), zero.alias("length"), zero.alias("total"))

    def step(a: Column, hit: Column) -> Column:
        fresh = a["run"] <= 0
        run = F.when(fresh, 0).otherwise(a["run"]) + F.when(hit, 1).otherwise(-MISMATCH)
        same = F.when(fresh, 0).otherwise(a["same"]) + F.when(hit, 1).otherwise(0)
        size = F.when(fresh, 0).otherwise(a["size"]) + 1
        better = run > a["score"]
        return F.struct(
            run.alias("run"), same.alias("same"), size.alias("size"), F.when(better, run).otherwise(a["score"]).alias("score"),
            F.when(better, same).otherwise(a["matched"]).alias("matched"), F.when(better, size).otherwise(a["length"]).alias("length"),
            (a["total"] + F.when(hit, 1).otherwise(0)).alias("total"),
        )

    hits = F.transform(item, lambda x, j: F.coalesce(F.get(hashes, shift + j) == x, F.lit(False)))
    return F.aggregate(hits, start, step)


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, with the best overlap of each.

    Word positions of both sides are hashed under the fixed masks; equal hashes lay an item on a document,
    and the words around are compared there, so substituted words are tolerated. Hits are verified where
    they arise, beside the document's own words: nothing but verified pairs is shuffled. Items go in
    blocks of about BLOCK_SEEDS seeds, each broadcast, so a benchmark of any size works.

    A pair leaks if LEAST_WORDS words, or LEAST_SHARE of the item's, agree in a stretch where a differing
    word costs MISMATCH, or if LEAST_SHARE of the item's words agree over the whole item, wherever the
    others stand.

    Null and empty texts on either side match nothing. Rows of one id are taken together; null ids are an
    id of their own. Empty tables give no rows; other columns are ignored. Returns doc_id, item_id,
    matched, length (words of the best stretch, or of the whole item where only that leaks), item_words,
    position (of the item's first word).
    """
    item_words = F.filter(words(F.col("text")), lambda w: w != "")
    items = benchmark.select(F.col("item_id").cast("long"), F.transform(item_words, lambda w: F.xxhash64(w)).alias("item")).where(F.size("item") > 0).distinct()
    items = items.withColumn("key", F.xxhash64("item"))
    short = F.collect_set(F.when(F.size("item").isin(*SHORT_MASKS), F.size("item")))
    held = items.agg(F.sum(F.size("item")).alias("n"), F.max(F.size("item")).alias("most"), short.alias("short")).first()
    masks = [*MASKS, *sorted({m for n in held["short"] for m in SHORT_MASKS[n]})]
    on_items = {m: F.lit(True) if m in MASKS else F.size("item").isin([n for n, own in SHORT_MASKS.items() if m in own]) for m in masks}
    blocks = -(-(held["n"] or 0) * len(masks) // BLOCK_SEEDS) or 1
    rows = windows(documents, max(held["most"] or 0, *map(len, masks)))
    found = []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == b)
        # at most about BLOCK_SEEDS rows of six integers, counted above; a seed that an item has at several places meets each of them
        before = F.coalesce(*[F.when(F.col("mask") == k, seed_of(F.col("item"), F.col("at") - 1, k, m)) for k, m in enumerate(masks)])
        table = with_seeds(own, "item", F.lit(0), F.size("item") - 1, on_items).select("mask", "seed", "item_id", "key", F.col("at").alias("from"), before.alias("before"))
        hits = with_seeds(rows, "words", F.col("low"), F.col("high"), dict.fromkeys(masks, F.lit(True))).join(F.broadcast(table), ["mask", "seed"])
        # the words of the block's items, eight bytes for every len(masks) seeds, come to the first hits of runs alone
        hits = hits.where(first_of_run(masks)).join(F.broadcast(own), ["item_id", "key"])
        shift = F.col("at") - F.col("from")
        # a generated column, as a filter of it stays above the join and does not work it out twice
        laid = F.explode_outer(F.array(overlap(F.col("item"), F.col("words"), shift))).alias("o")
        judged = hits.select("doc_id", "item_id", F.size("item").alias("item_words"), (F.col("start") + shift).alias("position"), laid)
        share = F.ceil(F.col("item_words") * LEAST_SHARE)
        stretch, whole = F.col("o.matched") >= F.least(F.lit(LEAST_WORDS), share), F.col("o.total") >= share
        matched, length = (F.when(stretch, F.col(f"o.{a}")).otherwise(F.col(b)).alias(a) for a, b in (("matched", "o.total"), ("length", "item_words")))
        found.append(judged.where(stretch | whole).select("doc_id", "item_id", "item_words", "position", matched, length))
    best = F.max(F.struct("matched", F.negative("length").alias("length"), F.negative("position").alias("position"), "item_words")).alias("b")
    return (
        reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(best)
        .select("doc_id", "item_id", "b.matched", F.negative("b.length").alias("length"), "b.item_words", F.negative("b.position").alias("position"))
    )


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no benchmark item, with all their columns.

    A row goes by its own text: of rows that share a null or repeated doc_id only those go whose text leaks.
    Null and empty texts stay; an empty table or benchmark loses nothing.
    """
    with Scratch(documents.sparkSession) as t:
        mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(23))
        keyed = documents.select(mark.alias("doc_id"), "text")
        # a text is its hash here; equal texts leak alike
        marks = t.small("marks", leaks(keyed, benchmark).select(F.col("doc_id").alias("leaking_")).distinct(), BROADCAST_IDS)
    return documents.join(marks, F.xxhash64(F.coalesce(documents["text"].cast("string"), F.lit("")), F.lit(23)) == marks["leaking_"], "left_anti")
