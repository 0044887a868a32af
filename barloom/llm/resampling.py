"""Importance resampling towards a target's word distribution: array-scored weights, sorted runs, tournament merges."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch, slices, small_batches
from barloom.llm.terms import LETTERS_AND_DIGITS, word_codes

#: Bytes of text turned into arrays at once.
TEXT_BYTES = 2 << 20
#: Most rows of a block of a sorted run; the merge opens blocks as their heads are reached.
BLOCK_ROWS = 1000
#: Rows that a merge range holds, about, and the most ranges: their bounds are the driver's part of the merge (three integers each).
RANGE_ROWS, MOST_RANGES = 10_000, 4096
#: Sampled keys for each range. The sample places the bounds of the ranges and nothing else.
KEYS_PER_RANGE = 16

ROWS = "doc_id long, row_ long, n_features long, weight long, score long"
BLOCKS = (
    "range int, score_ long, absent_ boolean, id_ long, head_ long, n int, "
    "scores array<long>, ids array<long>, numbers array<long>, features array<long>, weights array<long>"
)
DRAWN = "rank long, doc_id long, row_ long, n_features long, weight long, score long"
#: The order of the draw: larger scores, then smaller doc_id (null last), then the row's number.
Key = tuple[int, bool, int, int]
LAST: Key = (1 << 63, True, 0, 0)


def buckets_of(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word (unsigned crc32 of its bytes modulo `buckets`), and for each text the number of its first word."""
    codes, words, first = word_codes(column, LETTERS_AND_DIGITS, lower=True)
    each = np.fromiter((zlib.crc32(w.as_buffer()) % buckets for w in words), np.int64, len(words))
    return each[codes], first


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Words in each bucket over all texts: one array a task, then one sum a bucket; the driver gets `buckets` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                total += np.bincount(buckets_of(part.column("text"), buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    small_batches(texts.sparkSession)
    counted = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed source share) of each bucket."""
    n, all_source, all_target = len(source), float(source.sum() + len(source)), float(target.sum() + len(source))
    return np.fromiter((math.floor(1000 * math.log((float(target[b]) + 1) * all_source / ((float(source[b]) + 1) * all_target))) for b in range(n)), np.int64, n)


def noise(doc_id: int | None, seed: int) -> int:
    """A Gumbel draw in thousandths from the first 8 hex digits of sha256(`seed:doc_id`); a null id hashes as nothing after the colon."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(gain: np.ndarray, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                each, first = buckets_of(part.column("text"), len(gain))
                weight = np.diff(np.concatenate([[0], np.cumsum(gain[each])])[first])
                drawn = np.fromiter((noise(d, seed) for d in part.column("doc_id").to_pylist()), np.int64, part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_"), *(pa.array(x, pa.int64()) for x in (np.diff(first), weight, weight + drawn))],
                    ["doc_id", "row_", "n_features", "weight", "score"],
                )

    return run


def keys_of(rows: pa.RecordBatch | pa.Table) -> list[Key]:
    """Ascending keys for the order of the draw."""
    return [(-s, d is None, d or 0, r) for s, d, r in zip(rows.column("score").to_pylist(), rows.column("doc_id").to_pylist(), rows.column("row_").to_pylist(), strict=True)]


def cut_runs(bounds: list[Key]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows of a task, a run, as blocks that each lie in one range; a range begins behind its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            keys = keys_of(batch)
            start, out = 0, []
            while start < len(keys):
                while at < len(bounds) and bounds[at] < keys[start]:
                    at += 1
                stop = min(len(keys), start + BLOCK_ROWS)
                if at < len(bounds) and keys[stop - 1] > bounds[at]:
                    low, high = start, stop  # the first row behind the bound
                    while low < high:
                        middle = (low + high) // 2
                        low, high = (middle + 1, high) if keys[middle] <= bounds[at] else (low, middle)
                    stop = low
                score, absent, number, row = keys[start]
                part = batch.slice(start, stop - start)
                out.append((at, -score, absent, number, row, stop - start, *(part.column(c).to_pylist() for c in ("score", "doc_id", "row_", "n_features", "weight"))))
                start = stop
            if out:
                kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 5]
                names = ["range", "score_", "absent_", "id_", "head_", "n", "scores", "ids", "numbers", "features", "weights"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


class Tournament:
    """A winner tree over the heads of open blocks: the least head is found at the root, a new head costs one path to it."""

    def __init__(self) -> None:
        self.size, self.keys, self.tree, self.free = 1, [LAST], [0, 0], [0]

    def winner(self) -> int:
        return self.tree[1]

    def put(self, leaf: int, key: Key) -> None:
        self.keys[leaf] = key
        keys, tree, at = self.keys, self.tree, (self.size + leaf) // 2
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if keys[a] <= keys[b] else b
            at //= 2

    def open(self, key: Key) -> int:
        """A leaf for another block; the tree doubles when all are taken."""
        if not self.free:
            self.free = list(range(2 * self.size - 1, self.size - 1, -1))
            self.keys += [LAST] * self.size
            self.size *= 2
            self.tree = [0] * self.size + list(range(self.size))
            for at in range(self.size - 1, 0, -1):
                a, b = self.tree[2 * at], self.tree[2 * at + 1]
                self.tree[at] = a if self.keys[a] <= self.keys[b] else b
        leaf = self.free.pop()
        self.put(leaf, key)
        return leaf

    def close(self, leaf: int) -> None:
        self.put(leaf, LAST)
        self.free.append(leaf)


def merged(blocks: Iterator[dict], most: int) -> Iterator[tuple]:
    """Rows (doc_id, row_, n_features, weight, score) of one range in order, at most `most`, from blocks in the order of their heads.

    A block is opened when the merge has come to its head, so of each run one block is open at most and
    the others stay with Spark. The merge ends with the last row that is asked for.
    """
    tree, held, at, taken = Tournament(), {}, {}, 0
    ahead = next(blocks, None)
    head = lambda b: (-b["score_"], b["absent_"], b["id_"], b["head_"])
    while taken < most:
        leaf = tree.winner()
        while ahead is not None and head(ahead) < tree.keys[leaf]:
            leaf = tree.open(head(ahead))
            held[leaf], at[leaf] = ahead, 0
            ahead, leaf = next(blocks, None), tree.winner()
        if tree.keys[leaf] == LAST:
            return
        block, i = held[leaf], at[leaf]
        yield block["ids"][i], block["numbers"][i], block["features"][i], block["weights"][i], block["scores"][i]
        taken += 1
        if i + 1 < block["n"]:
            at[leaf], d = i + 1, block["ids"][i + 1]
            tree.put(leaf, (-block["scores"][i + 1], d is None, d or 0, block["numbers"][i + 1]))
        else:
            tree.close(leaf)
            del held[leaf], at[leaf]


def merge_ranges(before: dict[int, int], draw: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merge the ranges of a task and number their rows on from the rows `before` each range, up to rank `draw`."""
    names = [x.split()[0] for x in DRAWN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
        ahead, out = next(rows, None), []

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
            out.clear()
            return done

        while ahead is not None:
            now = ahead["range"]

            def own(now: int = now) -> Iterator[dict]:
                nonlocal ahead
                while ahead is not None and ahead["range"] == now:
                    block, ahead = ahead, next(rows, None)
                    yield block

            blocks = own()
            for rank, row in enumerate(merged(blocks, draw - before[now]), before[now] + 1):
                out.append((rank, *row))
                if len(out) == BLOCK_ROWS:
                    yield flush()
            for _ in blocks:  # what the draw leaves of its last range
                pass
        if out:
            yield flush()

    return run


def resample(documents: DataFrame, target: DataFrame, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """Weigh every document by how its words lean to the target, and draw the best `percent` of a hundred of those with enough words.

    Words are runs of ASCII letters and digits and of other characters, with A-Z lowered. The bucket counts
    of both tables and the gains are arrays of `buckets` numbers whatever the input. A row's score is its
    weight (the sum of its words' gains) and Gumbel noise from its id, so taking the largest scores draws
    without replacement by weight. Each task sorts its eligible rows; the sorted run is cut at range bounds
    into blocks; ranges are merged side by side by tournament trees, and only up to the range in which
    the draw ends, which stops there. Ranks count on from range to range.

    Null texts have no words; a null doc_id has noise of its own and comes last among ties; of rows that repeat
    an id and tie, the earlier in the table comes first, and each has its own rank. An empty table gives no
    rows, an empty target leaves the smoothing alone to weigh; other columns are ignored.
    Returns doc_id, n_features, weight, score, rank (null if not drawn).
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row_"))
    gain = gains(bucket_counts(texts, buckets), bucket_counts(target, buckets))
    with Scratch(spark) as t:
        rows = t.keep("rows", texts.mapInArrow(scored(gain, seed), ROWS))
        eligible = rows.where(F.col("n_features") >= least_words)
        n = eligible.count()
        draw = percent * n // 100
        plain = lambda df, rank: df.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
        if not draw:
            return plain(rows, F.lit(None).cast("long"))
        ranges = min(MOST_RANGES, -(-n // RANGE_ROWS))
        every = max(1, n // (ranges * KEYS_PER_RANGE))
        # about MOST_RANGES * KEYS_PER_RANGE rows of three integers at most
        sample = sorted(keys_of(eligible.where(F.pmod(F.xxhash64("row_"), every) == 0).select("score", "doc_id", "row_").toArrow())) if ranges > 1 else []
        bounds = sample[KEYS_PER_RANGE::KEYS_PER_RANGE]
        order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row_")]
        blocks = t.keep("blocks", eligible.sortWithinPartitions(*order).mapInArrow(cut_runs(bounds), BLOCKS))
        before, passed = {}, 0
        for k, size in sorted((r["range"], r["n"]) for r in blocks.groupBy("range").agg(F.sum("n").alias("n")).collect()):
            last, before[k] = k, passed
            passed += size
            if passed >= draw:
                break
        heads = [F.asc("range"), F.desc("score_"), F.asc("absent_"), F.asc("id_"), F.asc("head_")]
        front = blocks.where(F.col("range") <= last).repartition(len(before), "range").sortWithinPartitions(*heads)
        drawn = t.keep("drawn", front.mapInArrow(merge_ranges(before, draw), DRAWN))
        t.drop("blocks")
        end = drawn.where(F.col("rank") == draw).first()
    # a row comes after the last drawn one by the same order
    known, number = F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id"), F.lit(0))
    rest = (F.col("n_features") < least_words) | (F.col("score") < end["score"]) | (
        (F.col("score") == end["score"]) & (F.struct(~known, number, F.col("row_")) > F.struct(F.lit(end["doc_id"] is None), F.lit(end["doc_id"] or 0).cast("long"), F.lit(end["row_"]).cast("long")))
    )
    return plain(drawn, F.col("rank")).unionByName(plain(rows.where(rest), F.lit(None).cast("long")))
