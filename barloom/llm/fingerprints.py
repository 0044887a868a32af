"""Document fingerprints from closed syncmers."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import mix, runs_of, small_batches

#: k-mers of code points, and their inner substrings.
K, S = 16, 4
#: Anchors that a fingerprint keeps: those with the smallest hashes.
KEPT = 64
#: Bits of an anchor's hash, and of its position (modulo their power of two), that a fingerprint keeps.
HASH_BITS, PLACE_BITS = 40, 24
#: Rows for each sorted run, and most runs.
RUN_ROWS, RUNS = 4000, 20_000


def syncmers(codes: np.ndarray, lengths: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and 64-bit hash of every closed syncmer of texts that stand in a row.

    A k-mer is one if the smallest hash of its s-mers is that of its first or its last s-mer; this
    depends on its own characters only. A text shorter than k has itself as its only anchor; an empty
    text has none. k must be a multiple of s.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    found: list[np.ndarray] = []
    n = len(codes)
    if n >= k:
        c = codes.astype(np.uint64)
        inner = c[: n - s + 1].copy()
        for j in range(1, s):
            inner *= np.uint64(0x9E3779B97F4A7C15)
            inner += c[j : n - s + 1 + j]
        inner = mix(inner)
        w = k - s + 1
        low, width = inner, 1
        while 2 * width <= w:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < w:
            low = np.minimum(low[: len(low) - (w - width)], low[w - width :])
        m = n - k + 1
        chosen = np.flatnonzero((low[:m] == inner[:m]) | (low[:m] == inner[w - 1 : w - 1 + m]))
        text = np.searchsorted(ends, chosen, side="right")
        inside = chosen + k <= ends[text]
        chosen, text = chosen[inside], text[inside]
        whole = np.zeros(len(chosen), np.uint64)
        for j in range(0, k, s):
            whole = whole * np.uint64(0xD6E8FEB86659FD93) + inner[chosen + j]
        found = [text, chosen - starts[text], mix(whole)]
    else:
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
    if len(short):
        hashes = np.array([int.from_bytes(hashlib.blake2b(codes[starts[i] : ends[i]].astype("<u4").tobytes(), digest_size=8).digest(), "little") for i in short], np.uint64)
        found = [np.concatenate(x) for x in zip(found, (short, np.zeros(len(short), np.int64), hashes), strict=True)]
        order = np.argsort(found[0], kind="stable")
        found = [x[order] for x in found]
    return found[0], found[1], found[2]


def pieces(own: np.ndarray, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of every s-mer of one text, and of the text itself at position 0."""
    hashes = np.frombuffer(hashlib.blake2b(own.astype("<u4").tobytes(), digest_size=8).digest(), "<u8").astype(np.uint64)
    m = max(0, len(own) - s + 1)
    inner = np.zeros(m, np.uint64)
    for j in range(s if m else 0):
        inner = inner * np.uint64(0x9E3779B97F4A7C15) + own[j : j + m].astype(np.uint64)
    return np.concatenate([[0], np.arange(m)]).astype(np.int64), np.concatenate([hashes, mix(inner)])


def anchors_of(codes: np.ndarray, lengths: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and hash of the anchors of texts that stand in a row; only an empty text has none.

    From 2k - s - 1 code points on every text holds a closed syncmer. A shorter one may hold none or a
    single one, so its anchors are its s-mers and itself: equal for equal texts only, and an edit keeps some.
    """
    found = syncmers(codes, lengths, k, s)
    least = 2 * k - s - 1
    short = np.flatnonzero((lengths > 0) & (lengths < least))
    if not len(short):
        return found
    long = lengths[found[0]] >= least
    parts = [tuple(x[long] for x in found)]
    for i, end in zip(short, np.cumsum(lengths)[short], strict=True):
        at, hashes = pieces(codes[end - lengths[i] : end], s)
        parts.append((np.full(len(at), i), at, hashes))
    text, at, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(text, kind="stable")
    return text[order], at[order], hashes[order]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """For each text the KEPT anchors with the smallest distinct hashes (top HASH_BITS bits), each with its first position, ascending."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    text, at, hashes = anchors_of(codes, lengths)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    place = np.uint64(PLACE_BITS)
    packed = (hashes >> np.uint64(64 - HASH_BITS) << place) | (at.astype(np.uint64) & np.uint64((1 << PLACE_BITS) - 1))

    def smallest(h: np.ndarray) -> np.ndarray:
        h = np.sort(h)
        return h[np.concatenate([[True], h[1:] >> place != h[:-1] >> place])][:KEPT] if len(h) else h

    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        h = packed[a:b]
        part = h
        if len(h) > 4 * KEPT:  # repeats may fill a first cut, so a wider one is tried before all are sorted
            limit = np.partition(h, 3 * KEPT)[3 * KEPT] >> place
            part = smallest(h[h >> place < limit])
            part = part if len(part) >= KEPT else h
        out.append(smallest(part))
    return out


def to_text(sketch: np.ndarray) -> str:
    """Hex digits of each anchor's hash and position."""
    return "".join([f"{x:016x}" for x in sketch.tolist()])


def in_order(places: list[int]) -> int:
    """The most of the places that stand in order, none before an earlier one."""
    ends: list[int] = []
    for x in places:
        k = bisect_right(ends, x)
        ends[k : k + 1] = [x]
    return len(ends)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two anchor sets by positional matching.

    Of the smallest hashes of both sets together, those that both hold are matched, and as many of these
    count as stand in the same order in both texts; so anchors that two texts share in another order tell
    little. Two empty fingerprints are alike (1), one empty and one not are unlike (0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    place = np.uint64(PLACE_BITS)
    x, y = a >> place, b >> place
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    total = min(KEPT, len(x) + len(y) - len(both))
    if not len(both):
        return 0.0
    if len(x) + len(y) - len(both) > KEPT:
        inside = both <= np.partition(np.union1d(x, y), KEPT - 1)[KEPT - 1]
        i, j = i[inside], j[inside]
    mask = np.uint64((1 << PLACE_BITS) - 1)
    p, q = (a[i] & mask).astype(np.int64), (b[j] & mask).astype(np.int64)
    return in_order(q[np.lexsort((q, p))].tolist()) / total


def anchors(documents: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id, position and hash of every anchor of every whole text, for positional matching.

    Null and empty texts have none. Rows that repeat and null ids are kept; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py() or ""
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
                _, at, h = anchors_of(codes, np.array([len(text)], np.int64), k, s)
                ids = batch.column("doc_id").slice(i, 1).take(pa.array(np.zeros(len(at), np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(h.view(np.int64))], ["doc_id", "position", "hash"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, position long, hash long")


def fingerprint(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text: the hex digits of its anchors with the smallest hashes, and of their positions.

    Null and empty texts have the empty fingerprint, and only they. Rows that repeat and null ids are kept;
    an empty table gives no rows; other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in runs_of(frame["text"].fillna("").tolist()):
                out = [to_text(x) for x in sketches(frame["text"].fillna("").tolist()[part])]
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[part], "fingerprint": out})

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(run_rows: list[tuple[int | None, str]], following: tuple[int | None, str]) -> Iterator[pd.DataFrame]:
    texts = [t for _, t in run_rows] + [following[1]]
    for part in runs_of(texts[:-1]):
        own = texts[part.start : part.stop + 1]
        changed = [edited(a, b) for a, b in zip(own, own[1:], strict=False)]
        first, second = sketches(own), sketches(changed)
        yield pd.DataFrame({
            "doc_id": pd.array([d for d, _ in run_rows[part]], "Int64"), "n_chars": [len(t) for t in own[:-1]],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            "fingerprint": [to_text(x) for x in first[:-1]], "edited_fingerprint": [to_text(x) for x in second],
            "near_edited": [likeness(a, b) for a, b in zip(first, second, strict=False)],
            "near_next": [likeness(a, b) for a, b in zip(first, first[1:], strict=False)],
        })


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows in order, each closed by a guest row: the first row of the run that follows."""
    held: list[tuple[int | None, str]] = []
    size = 0
    for batch in batches:
        for run, guest, doc, text in zip(*(batch.column(c).to_pylist() for c in ("run", "guest", "doc_id", "text")), strict=True):
            row = (doc, text or "")
            if guest:
                if held:  # further guests of a run repeat its follower's id
                    for out in _compare(held, row):
                        yield pa.RecordBatch.from_pandas(out, preserve_index=False)
                held, size = [], 0
                continue
            held.append(row)
            size += len(row[1])
            if size >= 1 << 20:
                for out in _compare(held[:-1], held[-1]) if len(held) > 1 else ():
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)
                held, size = held[-1:], len(held[-1][1])


def run_bounds(ids: DataFrame, parts: int) -> np.ndarray:
    """Ascending ids that end runs of about equal size; an id that fills several of them stands alone in its own."""
    if parts < 2:
        return np.empty(0, np.int64)
    shares = [k / parts for k in range(1, parts)]
    got = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * parts)).alias("q")).first()["q"] or []
    ends, times = np.unique(np.array(got, np.int64), return_counts=True)
    hot = ends[(times > 1) & (ends > np.iinfo(np.int64).min)]
    return np.union1d(ends, hot - 1)


def fingerprint_edits(documents: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text, whose last third comes from the next document.

    Next: the next lower doc_id; after the lowest (nulls are lowest) the highest; rows of one doc_id
    follow by a hash of their text. The driver sees quantiles of doc_id and the counts and highest ids of
    the runs between them, RUNS at most; an id or the nulls with more rows than a run are cut into runs by
    that hash. Each run gets the first row of the next run as a guest, so each text is shuffled once and a
    task streams its sorted runs. Null texts are empty. An empty table gives no rows; other columns are
    ignored. Returns the columns of EDITED.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = documents.count()
    ends = run_bounds(rows.select("doc_id"), min(RUNS, -(-total // RUN_ROWS)))
    # runs are numbered in the order of the walk, from the highest id; nulls come last
    number = F.pandas_udf(lambda ids: pd.Series(len(ends) - np.searchsorted(ends, ids.to_numpy()), dtype="int32"), "int")
    place = F.when(F.col("doc_id").isNull(), F.lit(len(ends) + 1)).otherwise(number(F.coalesce("doc_id", F.lit(0).cast("long"))))
    rows = rows.withColumn("range", place).withColumn("salt", F.shiftrightunsigned(F.xxhash64("text", F.lit(29)), 1))
    ranges = rows.groupBy("range").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"), F.min("doc_id").eqNullSafe(F.max("doc_id")).alias("alone")).orderBy("range").collect()
    plan, run = [], 0
    for r in ranges:
        parts = -(-r["n"] // RUN_ROWS) if r["alone"] and r["n"] > 2 * RUN_ROWS else 1
        plan.append((r["range"], run, parts))
        run += parts
    spark = documents.sparkSession
    # at most 2 * RUNS + 2 ranges of three numbers: bounded, so broadcast
    rows = rows.join(F.broadcast(spark.createDataFrame(plan, "range int, first int, parts int")), "range")
    rows = rows.withColumn("run", (F.col("first") + F.when(F.col("parts") > 1, F.floor(F.shiftright("salt", 47) * F.col("parts") / 65536)).otherwise(0)).cast("int"))
    if run > len(ranges):
        tops = rows.groupBy("run").agg(F.max("doc_id").alias("top"), F.min(F.when(F.col("parts") > 1, F.col("salt"))).alias("least")).orderBy("run").collect()
    else:
        tops = [{"run": k, "top": r["top"], "least": None} for k, r in enumerate(ranges)]
    hosts = [(t["run"], t["top"], t["least"], tops[k - 1]["run"]) for k, t in enumerate(tops)]
    rows = rows.join(F.broadcast(spark.createDataFrame(hosts, "run int, top long, least long, host int")), "run")
    own = F.struct(F.col("run"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("host").alias("run"), F.lit(True).alias("guest"))
    leads = F.col("doc_id").eqNullSafe(F.col("top")) & F.coalesce(F.col("salt") == F.col("least"), F.lit(True))
    dealt = rows.select("doc_id", "text", "salt", F.explode(F.when(leads, F.array(own, guest)).otherwise(F.array(own))).alias("to")).select("doc_id", "text", "salt", "to.run", "to.guest")
    parts = max(1, min(len(tops), RUNS))
    ordered = dealt.repartitionById(parts, F.pmod("run", F.lit(parts))).sortWithinPartitions("run", "guest", F.desc_nulls_last("doc_id"), "salt", "text")
    return ordered.select("run", "guest", "doc_id", "text").mapInArrow(_walk, EDITED)
