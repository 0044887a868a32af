"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of text that a task turns into numpy arrays at once; a single longer text stands alone.
SLICE_BYTES = 1 << 18
#: Most rows of a few numbers each that are broadcast, always after a count.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch. Texts are long, and Spark's own bounds let a batch of them fill tens of MB in each process that touches it.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches; a bound that the session has set lower stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(str(spark.conf.get(key)).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or where that is unset (tests) one under the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return where or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"


class Scratch:
    """Tables of one run, written as Parquet in the shared folder: they cut the lineage, outlive lost executors and are read by column.

    `keep` writes a table at once and returns its reader; `drop` deletes tables that nothing still to be
    computed reads. What is kept at the end is what the lazy result reads. If the run fails, all go.
    """

    def __init__(self, spark: SparkSession) -> None:
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/barloom-{uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind:
            self._delete(self.root)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def small(self, name: str, df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
        """A kept table of a few numbers a row, marked for broadcast only if its count allows it; else it is joined by a shuffle."""
        df = self.keep(name, df)
        return F.broadcast(df) if df.count() <= most else df

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets from 0; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold at most about `most` bytes, in order; each has a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def runs_of(texts: list[str], most: int = 1 << 20) -> Iterator[slice]:
    """Consecutive parts of about `most` code points, of one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that near inputs get unrelated outputs."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def held_out() -> F.col:
    """True for rows whose labels no model may see: crc32 of doc_id as text, mod 3, is 1."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_ids(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id and label (0/1) of at most `per_class` labelled rows of each class outside the held-out fold.

    The bound is the caller's documented parameter; which rows are taken depends on a hash of doc_id alone.
    Rows with a null doc_id or label are left out; of several labels of a document the largest counts.
    """
    rows = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .withColumn("order", F.xxhash64("doc_id", F.lit(17)))
    )
    parts = [rows.where(F.col("label") == k).orderBy("order", "doc_id").limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "label")


def training_rows(documents: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int) -> DataFrame:
    """doc_id, label, text and a hashed `order` of the training ids, one row each, so that the driver's part is bounded in rows and bytes.

    Of rows that repeat an id the text with the smallest hash counts. A text of more than `chars` code
    points gives 20 evenly spread pieces of it that hold `chars` together; both bounds are the caller's
    documented parameters and concern the fit alone. Null texts are empty.
    """
    chosen = training_ids(documents, labels, label, per_class)
    # at most 2 * per_class rows of two integers: bounded, so broadcast
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    size = F.length("text")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.substring(F.col("text"), (k * F.floor(size / 20) + 1).cast("int"), F.lit(chars // 20)))
    rows = rows.withColumn("text", F.when(size > chars, F.array_join(pieces, " ")).otherwise(F.col("text")))
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.xxhash64("doc_id", F.lit(3)).alias("order"))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 texts in a row: starts, ends, 64-bit hashes of the words with
    A-Z lowered, and for each text the number of its first word (n + 1 entries)."""
    n = len(data)
    word = ~_BLANK[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.concatenate([[False], word[:-1]]) if n else word
    starts = np.flatnonzero(word & (~before | border[:-1]))
    after = np.concatenate([word[1:], [False]]) if n else word
    ends = np.flatnonzero(word & (~after | border[1:])) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64), first
    lengths = ends - starts
    longest = int(lengths.max())
    powers = np.cumprod(np.full(longest + 1, 0x9E3779B97F4A7C15, np.uint64))
    powers[-1] = 0
    place = np.arange(starts[0], n) - np.repeat(starts, np.diff(np.concatenate([starts, [n]])))
    np.minimum(place, longest, out=place)
    values = (_LOWER[data[starts[0] :]].astype(np.uint64) + np.uint64(1)) * powers[place]
    values[~word[starts[0] :]] = 0
    hashes = np.add.reduceat(values, starts - starts[0])
    return starts, ends, mix(hashes + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first
