"""Exact n-gram Jaccard join by token groups, and the classes of linked documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Scratch, mix, slices, utf8, words_of

WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Two sets that link share this many of the first tokens that each shows (or all that the smaller may miss none of).
SHARED = 3
#: Bands of two smallest hashes that bring near copies to a first leader.
BANDS = 5
#: Documents of a block of a class, and of a block of others, on average at most.
LINKED, OTHERS = 500, 128
#: Queries that a task opens one group for, on average.
QUERIES = 1000
#: Tokens that a document of a block or a query counts for; longer documents make smaller blocks and parts.
TOKENS = 600
#: Partners that one copy of a leader's set is checked against, on average.
BLOCK = 256
#: Tokens that more classes than this show are put last in the order of tokens.
OFTEN = 40
#: Postings of one token that a task holds.
HELD = 100_000
#: Links that one task joins into classes; more go through shuffled rounds.
LAST_LINKS = 1 << 20

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_BAND = np.array([(k * 2 + 1) * 0x2545F4914F6CDD1D % (1 << 64) | 1 for k in range(1, 2 * BANDS + 1)], np.uint64)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of the texts in a row, ascending in each, and their numbers."""
    data, offsets = utf8(column)
    _, _, hashes, first = words_of(data, offsets)
    counts = np.diff(first)
    whole = np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        whole += hashes[k : k + len(whole)] * _STEP[k]
    whole = mix(whole)
    out = []
    for a, n in zip(first[:-1].tolist(), counts.tolist(), strict=True):
        if n >= WORDS:
            out.append(np.unique(whole[a : a + n - WORDS + 1]))
        elif n:
            out.append(mix((hashes[a : a + n] * _STEP[:n]).sum(keepdims=True) + np.uint64(n) * np.uint64(0xE7037ED1A0B428DB)))
        else:
            out.append(np.empty(0, np.uint64))
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), sizes


def shown(n: int) -> int:
    """How many first tokens of a set of n, in one order for all sets, any set that links to it shares SHARED of."""
    need = -(-PERCENT * n // 100)
    return n - need + min(SHARED, need)


def offered(n: int) -> int:
    """How many first tokens are compared, so that `shown` tokens are left when those that stand everywhere go last."""
    return min(n, shown(n) + max(8, shown(n) // 4))


def _list(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


SKETCH = "doc_id long, n long, sig long, sig2 long, bands array<long>, head array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, signature, bands and offered tokens of each set; the order of tokens is that of their hashes."""
    for batch in batches:
        for part in slices(batch, "text"):
            tokens, sizes = shingle_sets(part.column("text"))
            rows = len(sizes)
            sig, sig2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            low = np.zeros((rows, 2 * BANDS), np.uint64)
            full = np.flatnonzero(sizes)
            ends = np.cumsum(sizes)
            if len(full):
                at = (ends - sizes)[full]
                sig[full] = np.add.reduceat(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), at)
                sig2[full] = np.add.reduceat(mix(tokens + np.uint64(0x14057B7EF767814F)), at)
                for k in range(2 * BANDS):
                    low[full, k] = np.minimum.reduceat(tokens * _BAND[k], at)
            bands = mix(low[:, 0::2] * np.uint64(31) + low[:, 1::2] + np.arange(BANDS, dtype=np.uint64))
            heads = [tokens[e - n : e - n + offered(n)] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), pa.array(sig.view(np.int64)), pa.array(sig2.view(np.int64)), _list(list(bands)), _list(heads)],
                ["doc_id", "n", "sig", "sig2", "bands", "head"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            tokens, sizes = shingle_sets(part.column("text"))
            ends = np.cumsum(sizes)
            own = [tokens[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            short = pa.array([(x >> np.uint64(48)).astype("<u2").tobytes() for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), _list(own), short], ["doc_id", "n", "tokens", "short"])


POSTING = "token long, comp long, doc_id long, n long, place long, often boolean"


def _shared_postings(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of postings sorted by token and class, those of tokens that several classes show; `often` if more than `most` do.

    a token's rows are held until its classes are counted, but no more than HELD of them: then they go on
    as they are, and the flag of the token's other rows counts for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # rows of the last token met, which may go on
        token, known = None, False  # that token, and whether it is known to stand often

        def classes(part: pa.Table) -> int:
            return len(np.unique(part.column("class").to_numpy()))

        def out(part: pa.Table, often: np.ndarray | bool) -> Iterator[pa.RecordBatch]:
            flags = pa.array(np.broadcast_to(np.asarray(often), part.num_rows))
            yield from part.select(["token", "class", "doc_id", "n", "place"]).rename_columns(["token", "comp", "doc_id", "n", "place"]).append_column("often", flags).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("size").to_numpy()
            own = pc.coalesce(batch.column("comp"), batch.column("doc_id"))
            columns = [batch.column("token"), own, batch.column("doc_id"), pa.array(size >> 32), pa.array(size & 0xFFFFFFFF)]
            batch = pa.RecordBatch.from_arrays(columns, ["token", "class", "doc_id", "n", "place"])
            tokens = batch.column("token").to_numpy()
            edge = np.flatnonzero(tokens[1:] != tokens[:-1]) + 1
            first, last = (int(edge[0]), int(edge[-1])) if len(edge) else (batch.num_rows, 0)
            if token is not None and tokens[0] == token:
                if known:
                    yield from out(pa.Table.from_batches([batch.slice(0, first)]), True)
                else:
                    kept.append(batch.slice(0, first))
            else:
                first = 0
            if (len(edge) or tokens[0] != token) and kept:  # the held token has ended
                part = pa.Table.from_batches(kept)
                n = classes(part)
                if n > 1:
                    yield from out(part, n > most)
                kept = []
            start = first
            if len(edge) and last > start:  # whole tokens inside the batch
                part = pa.Table.from_batches([batch.slice(start, last - start)])
                t, g = part.column("token").to_numpy(), part.column("class").to_numpy()
                new_token = np.concatenate([[True], t[1:] != t[:-1]])
                run = np.cumsum(new_token) - 1
                fresh = new_token | np.concatenate([[True], g[1:] != g[:-1]])
                n = np.bincount(run, fresh)[run]
                some = np.flatnonzero(n > 1)
                yield from out(part.take(pa.array(some)), n[some] > most)
            if len(edge) or token is None or tokens[0] != token:
                token, known = int(tokens[-1]), False
                kept = [batch.slice(last if len(edge) else 0)]
            if not known and sum(k.num_rows for k in kept) > most:
                part = pa.Table.from_batches(kept)
                if classes(part) > most:
                    yield from out(part, True)
                    kept, known = [], True
                elif part.num_rows > HELD:
                    yield from out(part, False)
                    kept = [batch.slice(batch.num_rows - 1)]
        if kept:
            part = pa.Table.from_batches(kept)
            n = classes(part)
            if n > 1:
                yield from out(part, n > most)

    return run


def _deep_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole heads of sets whose offered tokens were too few; `last` are the set's tokens that go last."""
    for batch in batches:
        n = batch.column("n").to_pylist()
        ids, sizes, tokens = [], [], []
        for i in range(batch.num_rows):
            own = np.array(batch.column("tokens")[i].values, copy=False).view(np.uint64)
            often = np.sort(np.array(batch.column("last")[i].values, copy=False).view(np.uint64))
            late = np.isin(own, often)
            head = np.concatenate([own[~late], own[late]])[: shown(n[i])]
            ids.append(np.full(len(head), batch.column("doc_id")[i].as_py(), np.int64))
            sizes.append(np.full(len(head), n[i], np.int64))
            tokens.append(head.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, sizes, tokens)], ["doc_id", "n", "token"])


def needed(n: Column) -> Column:
    """How many tokens of a set of n a set that links to it shares at least."""
    return F.ceil(n * PERCENT / 100)


def common_at_least(n: Column, m: Column) -> Column:
    """How many tokens the heads of two sets of n and m share at least if the sets link.

    The head that ends first in the order of tokens holds only tokens that the other set has in its own
    head or not at all, and linking sets miss no more than n less their least overlap.
    """
    overlap = F.ceil((n + m) * PERCENT / (100 + PERCENT))
    return F.greatest(F.lit(1), overlap + F.least(F.lit(SHARED), needed(F.least(n, m))) - F.greatest(needed(n), needed(m)))


def alike(x: str, y: str) -> Column:
    """Whether sets of such sizes can link."""
    return (F.col(x) * 100 >= F.col(y) * PERCENT) & (F.col(y) * 100 >= F.col(x) * PERCENT)


def sets_for(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, n, the whole token set and its tokens' first 16 bits, of the documents whose ids are given (distinct, in column doc_id)."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, "doc_id", "left_semi")
    return rows.mapInArrow(_sets, "doc_id long, n long, tokens array<long>, short binary")


def overlaps(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two ascending sets of distinct tokens link."""
    if not 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)) > 0:
        return False
    if len(x) > len(y):
        x, y = y, x
    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[place] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets link, of rows by (a, block) in which the set of `a` (role 0) comes before those of its partners."""
    key, leaders = None, []
    for batch in batches:
        a, block, role, ids = (batch.column(c).to_numpy() for c in ("a", "block", "role", "doc_id"))
        tokens = batch.column("tokens")
        ends, flat = tokens.offsets.to_numpy(), np.array(tokens.values, copy=False).view(np.uint64)
        keep = []
        for i in range(batch.num_rows):
            own = flat[ends[i] : ends[i + 1]]
            if not role[i]:
                if key != (a[i], block[i]):
                    key, leaders = (a[i], block[i]), []
                leaders.append(own.copy())
            elif key == (a[i], block[i]) and any(overlaps(x, own) for x in leaders):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(ids[keep])], ["a", "b"])


def verified(documents: DataFrame, pairs: DataFrame, t: Scratch, name: str) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets link.

    The set of `a` goes once to each block of about BLOCK partners and stays there while they stream past,
    so neither a leader of a million copies nor its copies meet in one task.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    partners = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"), F.lit(1).alias("role"), F.col("b").alias("doc_id"))
    leaders = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("a").alias("doc_id"))
    wanted = t.small(f"{name}_wanted", leaders.unionByName(partners))
    ids = t.small(f"{name}_ids", wanted.select("doc_id").distinct())
    rows = sets_for(documents, ids).select("doc_id", "tokens").join(wanted, "doc_id").repartition("a", "block").sortWithinPartitions("a", "block", "role")
    out = t.keep(name, rows.select("a", "block", "role", "doc_id", "tokens").mapInArrow(_linked, "a long, b long"))
    t.drop(f"{name}_wanted", f"{name}_ids")
    return out


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition as a forest of stars: each node that is not the smallest of its tree, and that smallest."""
    parts = [(batch.column("u").to_numpy(), batch.column("v").to_numpy()) for batch in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (higher := root[root]).tobytes() != root.tobytes():
            root = higher
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    lower = np.flatnonzero(root < np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[lower]), pa.array(nodes[root[lower]])], ["u", "v"])


def components(edges: DataFrame, t: Scratch, name: str, last: int = LAST_LINKS) -> DataFrame:
    """node and root (the smallest node reachable) of every node of the edges (a, b).

    Each partition first turns its links into a forest, so a partition sends at most one link for each of
    its nodes. Up to `last` links (of 16 bytes) one task joins the forests; more go through rounds of large
    and small stars, shuffled by node, until nothing changes.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    e = t.keep(f"{name}_0", links.mapInArrow(_forest, "u long, v long"))
    if e.count() <= last:
        e = t.keep(f"{name}_1", e.coalesce(1).mapInArrow(_forest, "u long, v long"))
        t.drop(f"{name}_0")
    else:
        seen, k = None, 0
        while True:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            joined = large.join(low, "u")
            small_star = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            k += 1
            e = t.keep(f"{name}_{k}", small_star.distinct())
            t.drop(f"{name}_{k - 1}")
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == seen:
                break
            seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _open_groups(key: tuple, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a query and a member of one group that may link.

    The group's row of the token matrix is the union of its members' tokens, by their first 16 bits. A
    query that shares less than PERCENT of its own tokens with the union can link to no member; for
    others the group is opened and the overlaps with all members are counted at once. Bits can only add
    to an overlap, so no link is lost; whole tokens decide later. Groups and queries are bounded by tokens.
    """
    empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    if not len(members) or not len(queries):
        return empty
    each = [np.unique(np.frombuffer(x, "<u2")) for x in members["short"]]
    flat, owner = np.concatenate(each), np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each])
    order = np.argsort(flat, kind="stable")
    owner = owner[order]
    starts = np.searchsorted(flat[order], np.arange((1 << 16) + 1))
    ids, comps, sizes = members["doc_id"].to_numpy(), members["comp"].to_numpy(), members["n"].to_numpy()
    out = []
    for doc, comp, short in zip(queries["doc_id"], queries["comp"], queries["short"], strict=True):
        own = np.frombuffer(short, "<u2").astype(np.int64)
        first, length = starts[own], starts[own + 1] - starts[own]
        if 100 * int((length > 0).sum()) < PERCENT * len(own):
            continue
        spots = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
        both = np.minimum(np.bincount(owner[spots], minlength=len(ids)), np.minimum(sizes, len(own)))
        hit = (100 * both >= PERCENT * (sizes + len(own) - both)) & (comps != comp)
        out += [(min(doc, m), max(doc, m)) for m in ids[hit].tolist()]
    return pd.DataFrame(out, columns=["a", "b"]) if out else empty


def links(documents: DataFrame, t: Scratch, often: int = OFTEN) -> tuple[DataFrame, DataFrame]:
    """doc_id, n and the representative of the set's copies of every row, and links between representatives.

    The links join all representatives that any chain of linking pairs joins; links inside a class that is
    already joined are not all returned.
    """
    sketches = t.keep("sketches", documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sketch, SKETCH))
    some = sketches.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    same = some.groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    same = t.small("same", same.where("copies > 1").drop("copies"))
    rows = sketches.select("doc_id", "n", "sig", "sig2").join(same, ["sig", "sig2", "n"], "left")
    rows = t.keep("rows", rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("rep", "doc_id")).alias("rep")))
    # rows of one doc_id with several sets: each set's representative is linked to that doc_id
    repeated = t.small("repeated", some.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    own = t.keep("own", rows.where("rep <> doc_id").join(repeated, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    copies = t.small("copies", rows.where("rep <> doc_id").select("doc_id", "n").distinct())
    reps = some.select("doc_id", "n", "bands", "head").join(copies, ["doc_id", "n"], "left_anti")

    # first links: to the smallest document of a band's bucket
    bucketed = reps.select("doc_id", "n", F.posexplode("bands").alias("band", "key"))
    leaders = bucketed.groupBy("band", "key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last"), F.min_by("n", "doc_id").alias("n_a")).where("a < last").drop("last")
    pairs = bucketed.join(t.small("leaders", leaders), ["band", "key"]).where("a < doc_id").where(alike("n_a", "n")).select("a", F.col("doc_id").alias("b")).distinct()
    first = verified(documents, t.keep("pairs", pairs), t, "first")
    comps = t.small("comps", components(first, t, "first_comps"))
    t.drop("same", "repeated", "leaders", "pairs")

    # one shuffle of all offered tokens leaves those that several classes show
    sized = F.shiftleft("n", 32).bitwiseOR(F.col("place").cast("long")).alias("size")
    heads = reps.select("doc_id", "n", "head").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    postings = heads.select("doc_id", "n", F.col("root").alias("comp"), F.posexplode("head").alias("place", "token")).select("token", "comp", "doc_id", sized)
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.repartition(parts, "token").sortWithinPartitions("token", F.coalesce("comp", "doc_id"))
    met = t.keep("met", dealt.mapInArrow(_shared_postings(often), POSTING))
    late = t.small("late", met.where("often").select("token").distinct())
    met = met.drop("often").distinct().join(late.withColumn("often_", F.lit(True)), "token", "left").withColumn("often", F.col("often_").isNotNull()).drop("often_")
    # tokens that stand often go last: a token's place becomes that among the others
    whole = Window.partitionBy("doc_id", "n")
    before = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    late_here = F.col("often").cast("int")
    met = t.keep("ranked", met.withColumns({"rank": F.col("place") - F.sum(late_here).over(before), "late": F.sum(late_here).over(whole)}))
    t.drop("met")
    need = needed(F.col("n"))
    show = F.col("n") - need + F.least(F.lit(SHARED), need)
    offer = F.least(F.col("n"), show + F.greatest(F.lit(8), F.floor(show / 4)))
    few = (offer - F.col("late") < show) & (F.col("late") > 0)
    deep = t.small("deep", met.where(few).select("doc_id", "n").distinct())
    postings = met.where(~few & ~F.col("often") & (F.col("rank") < show)).select("token", "comp", "doc_id", "n")
    if not deep.isEmpty():
        # these sets hold little but tokens that stand often; their heads are worked out from all their tokens
        all_tokens = sets_for(documents, deep.select("doc_id"))
        late_of = all_tokens.select("doc_id", "n", F.explode("tokens").alias("token")).join(late, "token", "left_semi").groupBy("doc_id", "n").agg(F.collect_list("token").alias("last"))
        own_heads = t.keep("own_heads", all_tokens.join(late_of, ["doc_id", "n"]).mapInArrow(_deep_heads, "doc_id long, n long, token long"))
        fresh = t.small("fresh", own_heads.select("token").distinct())
        others = heads.join(deep, ["doc_id", "n"], "left_anti").select("doc_id", "n", F.coalesce("root", "doc_id").alias("comp"), F.posexplode("head").alias("place", "token"))
        others = others.join(fresh, "token", "left_semi").join(late, "token", "left_anti")
        # what others show of these tokens takes its place among all that they show
        more = met.select("token", "comp", "doc_id", "n", "place", "often").unionByName(others.withColumn("often", F.lit(False)))
        more = more.withColumn("rank", F.col("place") - F.sum(late_here).over(before))
        more = more.where(~F.col("often") & (F.col("rank") < show)).join(deep, ["doc_id", "n"], "left_anti").select("token", "comp", "doc_id", "n")
        mine = own_heads.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("token", F.coalesce("root", "doc_id").alias("comp"), "doc_id", "n")
        postings = mine.unionByName(more).distinct()
        shared = postings.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token")
        postings = postings.join(shared, "token", "left_semi")
    postings = t.keep("postings", postings.withColumn("linked", F.col("doc_id") != F.col("comp")))
    t.drop("ranked", "sketches", "copies", "comps", "first_comps_1", "late", "deep", "own_heads", "fresh")
    # groups: blocks of a class of near copies, and blocks of other documents by the token that most of these show:
    # documents that show the same tokens then fall into few groups, and a token meets few groups
    seen = postings.where(~F.col("linked")).groupBy("token").agg(F.count("*").alias("seen"))
    often_first = F.shiftleft(F.least(F.coalesce("seen", F.lit(0)), F.lit((1 << 20) - 1)), 43).bitwiseOR(F.col("token").bitwiseAND(F.lit((1 << 43) - 1)))
    keyed = postings.join(seen, "token", "left").groupBy("doc_id", "n", "comp", "linked").agg(F.max(often_first).alias("most"))
    keyed = t.keep("keyed", keyed.withColumn("key", F.when(F.col("linked"), F.col("comp")).otherwise(F.col("most"))).drop("most"))
    room = F.when(F.col("linked"), LINKED).otherwise(OTHERS)
    sizes = keyed.groupBy("linked", "key").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("size") / room), F.ceil(F.col("tokens") / (room * TOKENS))))
    # of two classes the smaller one asks, so that a large class meets a token's other classes as blocks, not as documents
    weight = F.least(F.when(F.col("linked"), F.col("size")).otherwise(1), F.lit((1 << 22) - 1))
    order = F.shiftleft(weight.cast("long"), 40).bitwiseOR(F.col("comp").bitwiseAND(F.lit((1 << 40) - 1)))
    grp = F.xxhash64("linked", "key", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    members = t.small("members", keyed.join(sizes, ["linked", "key"]).select("doc_id", "n", "comp", grp.alias("grp"), order.alias("order")))
    placed = postings.join(members.select("doc_id", "n", "grp", "order"), ["doc_id", "n"])
    group_side = placed.groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c"), F.max("comp").alias("d"), F.max("order").alias("top"))
    near = (F.col("high") * 100 >= F.col("n") * PERCENT) & (F.col("low") * PERCENT <= F.col("n") * 100)
    other = (F.col("c") != F.col("comp")) | (F.col("d") != F.col("comp"))
    asked = (
        placed.select("token", "doc_id", "n", "comp", "order").join(group_side, "token").where(near & other & (F.col("top") >= F.col("order")))
        .groupBy("doc_id", "n", "grp").agg(F.count("*").alias("common"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    # of two sets that link, the one whose head ends first misses few of its head's tokens in the other
    least, most = F.greatest("low", F.ceil(F.col("n") * PERCENT / 100)), F.least("high", F.floor(F.col("n") * 100 / PERCENT))
    enough = F.least(common_at_least(F.col("n"), least), common_at_least(F.col("n"), most)) - (least < most).cast("int")
    asked = t.keep("asked", asked.where(F.col("common") >= enough).select("doc_id", "n", "grp"))
    t.drop("postings", "keyed")
    first = first.unionByName(own)
    if asked.isEmpty():
        return rows, first
    # a group's queries go in parts, each beside all members of the group, so that both sides stay bounded
    parts = asked.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / QUERIES), F.ceil(F.sum("n") / (QUERIES * TOKENS))).cast("int").alias("parts"))
    parts = t.small("parts", parts)
    left = t.keep("left", members.select("doc_id", "n", "comp", "grp").join(parts, "grp"))
    right = t.keep("right", asked.join(parts, "grp").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")).join(members.select("doc_id", "n", "comp"), ["doc_id", "n"]))
    ids = t.small("open_ids", left.select("doc_id").union(right.select("doc_id")).distinct())
    short = t.keep("short", sets_for(documents, ids).select("doc_id", "n", "short"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").join(short, ["doc_id", "n"])
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # new column ids, so that the two sides are told apart
    right = right.drop("parts").join(short, ["doc_id", "n"])
    maybe = t.keep("maybe", left.groupBy("grp", "part").cogroup(right.groupBy("grp", "part")).applyInPandas(_open_groups, "a long, b long").distinct())
    t.drop("members", "asked", "parts", "left", "right", "open_ids", "short")
    second = verified(documents, maybe, t, "second")
    t.drop("maybe")
    return rows, first.unionByName(second)


def jaccard_classes(documents: DataFrame, often: int = OFTEN) -> DataFrame:
    """n_shingles and component_id of every row: the smallest doc_id that chains of linking documents reach.

    A-Z are lowered and words are `[^\\x20\\x09-\\x0D]+`. A set is the distinct WORDS-word shingles, as 64-bit
    hashes; fewer words are one shingle; no words or a null text make an empty set, which links with
    nothing. Sets link when 100 * intersection >= PERCENT * union.

    Equal sets are one representative. Near copies meet the first document of a band's bucket and are
    checked against it. The classes so found, cut into blocks, are groups; other documents that show the
    same token, of theirs the one shown most, are. Sets that link share SHARED of their first tokens in one
    common order; that brings each query to the few groups that may hold a partner, the group's token union
    bounds the overlap, and groups that qualify are opened. No pair that links is lost, and no group has to fit a task whole.

    Rows of one doc_id count as linked. Rows with a null doc_id get a null component. An empty table
    gives no rows; other columns are ignored. Returns doc_id, n_shingles, component_id.
    """
    with Scratch(documents.sparkSession) as t:
        rows, edges = links(documents, t, often)
        comps = components(edges, t, "comps_of_all")
        t.drop("first", "own", "second")
    return rows.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id")
    )


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """One document of each class, that with the class's smallest doc_id, with all columns; empty texts stay.

    Of rows that repeat one doc_id with a text one stays; rows with a null doc_id stay. An empty table gives no rows.
    """
    with Scratch(documents.sparkSession) as t:
        classes = t.keep("classes", jaccard_classes(documents).where("n_shingles > 0 AND doc_id IS NOT NULL"))
        gone = t.small("gone", classes.where("doc_id <> component_id").select(F.col("doc_id").alias("id_")).distinct())
        again = classes.where("doc_id = component_id").groupBy(F.col("doc_id").alias("id_")).agg(F.count("*").alias("n_")).where("n_ > 1").select("id_")
        again = t.small("again", again)
        t.drop("classes")
    kept = documents.join(gone, documents["doc_id"].cast("long") == gone["id_"], "left_anti")
    if again.isEmpty():
        return kept
    match = documents["doc_id"].cast("long") == again["id_"]
    return kept.join(again, match, "left_anti").unionByName(kept.join(again, match, "left_semi").dropDuplicates(["doc_id"]))
