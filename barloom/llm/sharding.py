"""Shards of near-equal size by a minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from barloom.llm.common import Scratch

#: Atomic groups: ranges of the hash of the text. Their number is fixed, so the driver's part of the search never grows.
GROUPS = 1 << 16
#: A group of more rows is numbered in several parts; the driver's table then has at most 2 * GROUPS rows.
PART_ROWS = 500


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity for which a greedy walk over the ordered sizes needs at most `shards` shards."""
    ends = list(accumulate(sizes))
    total = ends[-1] if ends else 0
    low, high = max([-(-total // shards), *sizes]), total

    def feasible(capacity: int) -> bool:
        at, used = 0, 0
        while at < len(sizes) and used <= shards:
            at = bisect_right(ends, (ends[at - 1] if at else 0) + capacity, lo=at)
            used += 1
        return used <= shards

    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def cut(sizes: list[int], shards: int) -> list[int]:
    """A shard for each of the ordered atomic sizes: contiguous, and the largest shard as small as it can be.

    A size above the mean of what the other shards share would leave shards beside it empty, so the order
    is parted there: the size is a shard, and the stretches before and after it get the shards left, each
    time the stretch with the largest shard. Where that would exceed the smallest capacity of the whole
    order, or there are too few shards for the stretches, the order is cut as one.
    """
    capacity = smallest_capacity(sizes, shards)
    left, total, alone = shards, sum(sizes), set()
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if left <= 1 or sizes[i] * left <= total:
            break
        alone.add(i)
        left, total = left - 1, total - sizes[i]
    stretches, start = [], 0
    for i in [*sorted(alone), len(sizes)]:
        if i > start:
            stretches.append((start, i))
        start = i + 1
    if alone and len(stretches) <= left:
        parts = [sizes[a:b] for a, b in stretches]
        given = [1] * len(parts)
        need = [smallest_capacity(p, 1) for p in parts]
        for _ in range(left - len(parts) if parts else 0):
            k = max(range(len(parts)), key=need.__getitem__)
            given[k] += 1
            need[k] = smallest_capacity(parts[k], given[k])
        if max(need, default=0) <= capacity:
            out, shard, where = [0] * len(sizes), 0, {a: k for k, (a, _) in enumerate(stretches)}
            for i in range(len(sizes)):
                if i in alone:
                    out[i], shard = shard, shard + 1
                elif i in where:
                    k = where[i]
                    own = near_equal_cuts(parts[k], given[k], need[k])
                    out[i : i + len(own)] = [shard + x for x in own]
                    shard += given[k]
            return out
    return near_equal_cuts(sizes, shards, capacity)


def near_equal_cuts(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """A shard for each ordered size: no shard above `capacity`, each cut as near the equal share as that allows.

    A cut may lie no earlier than where the rest still fits the shards left, and no later than where its
    own shard is full.
    """
    ends = [0, *accumulate(sizes)]
    n, total = len(sizes), ends[-1]
    earliest = [n] * shards  # the first place from which the shards after this one can hold the rest
    for j in range(shards - 2, -1, -1):
        earliest[j] = bisect_left(ends, ends[earliest[j + 1]] - capacity)
    out, start = [], 0
    for j in range(shards):
        latest = bisect_right(ends, ends[start] + capacity) - 1 if j < shards - 1 else n
        ideal = bisect_left(ends, total * (j + 1) // shards)
        if 0 < ideal <= n and total * (j + 1) // shards - ends[ideal - 1] < ends[ideal] - total * (j + 1) // shards:
            ideal -= 1
        stop = max(start, earliest[j], min(ideal, latest))
        out += [j] * (stop - start)
        start = stop
    return out


def shard_documents(documents: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Give every row a shard and a gapless place in it, with near-equal bytes and equal texts together.

    Size: UTF-8 bytes of the text (null: none) plus `overhead`. Rows are ordered by the hash of their
    text; the atomic groups are GROUPS hash ranges, so equal texts are never parted. The driver sees one
    count and one sum for each group, whatever the input; it searches the smallest capacity and cuts.
    Places come from counts of (group, part) and a row number within a part, so no task numbers a whole
    shard or a whole hot group. Text itself is never shuffled.

    Null texts are one group with the empty text. Rows that repeat get a place each. An empty table gives
    no rows. Other columns are ignored. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    with Scratch(documents.sparkSession) as t:
        # the narrow rows are written once: texts are read once, and each row's number in its task parts hot groups whatever the ids
        rows = t.keep("rows", documents.select(
            "doc_id",
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - (GROUPS.bit_length() - 1)).cast("int").alias("grp"),
            F.monotonically_increasing_id().alias("row_"),
        ))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("grp").collect()
    total = sum(g["n"] for g in groups)
    most = max(PART_ROWS, total // GROUPS)
    shard = cut([g["size"] for g in groups], shards)
    spark = documents.sparkSession
    kind = T.StructType([T.StructField("grp", T.IntegerType()), T.StructField("parts", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    plan = spark.createDataFrame([(g["grp"], -(-g["n"] // most), s) for g, s in zip(groups, shard, strict=True)], kind)
    # at most GROUPS rows of three integers: bounded, so broadcast
    rows = rows.join(F.broadcast(plan), "grp").withColumn(
        "part", F.when(F.col("parts") == 1, 0).otherwise(F.pmod(F.xxhash64("row_"), F.col("parts")).cast("int"))
    )
    # at most GROUPS + total / most rows, which is at most 2 * GROUPS
    counts = rows.groupBy("shard", "grp", "part").agg(F.count("*").alias("n"))
    first = counts.select(
        "grp", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("grp", "part")) - F.col("n")).alias("first")
    )
    place = F.row_number().over(W.partitionBy("grp", "part").orderBy("doc_id", "size", "text_crc32", "row_"))
    return (
        rows.withColumn("place", place - 1)
        .join(F.broadcast(first), ["grp", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
