"""Best-fit packing of documents into fixed-length token sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices, small_batches

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Documents, and bytes of text, that one packing task gets on average: enough that its last open sequences hardly count, and few enough for any executor.
GROUP_ROWS, GROUP_BYTES = 4096, 16 << 20
#: Words whose ids a Python worker keeps, about 50 MB of them, and bytes of text that it encodes at once.
CACHE_WORDS, TEXT_BYTES = 300_000, 1 << 20
#: Texts on which a tokenizer's whole encoding must equal that of its words, else it is refused.
PROBES = ("Plain words, and one.Two!", "CAPITALS Mixed 12 3.5 don't (x) a-b", "naïve café ß Ωmega 🎉 東京", "tabs\tand\nlines  twice ", "")
#: Lower-case words that are one word for the tokenizer however they stand: its normaliser leaves them as they are.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


class WordIds:
    """Ids of whole texts by a tokenizer that works word by word, with each distinct word encoded once.

    Text is parted at blanks and line feeds only, which the tokenizer drops, and between an ASCII letter
    and one of .,! (where its own rule parts it too); ASCII letters are lowered as its normaliser would.
    So the parts' ids, joined, are the text's ids. A text with a special token's lead `<|` goes whole to
    the tokenizer.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.clear()
        whole = [e.ids for e in self.tokenizer.encode_batch(list(PROBES), add_special_tokens=False)]
        ids, offsets = self.encode(pa.array(PROBES))
        if [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] != whole:
            raise ValueError(f"{path} does not tokenize word by word as this encoder needs")

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.offsets = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        plain = [w for w in words if _PLAIN(w)]
        known = set(plain)
        other = [w for w in words if w not in known]
        joined = [" ".join(plain[i : i + 500]) for i in range(0, len(plain), 500)]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(plain):
            raise ValueError("the tokenizer does not end each word with an end-of-word token")
        each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        lengths = np.concatenate([np.diff(ends, prepend=0), np.array([len(e) for e in each], np.int64)]).astype(np.int64)
        self.index.update(zip(plain + other, range(len(self.offsets) - 1, len(self.offsets) - 1 + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, ids, *each])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the n + 1 offsets of the texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        plain = pc.replace_substring_regex(pc.replace_substring(plain, "\n", " "), "([A-Za-z])([.,!])", r"\1 \2")
        words = pc.split_pattern(pc.ascii_lower(plain), " ")
        coded = words.flatten().dictionary_encode()
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        vocabulary = coded.dictionary.to_pylist()
        if len(self.index) > CACHE_WORDS:
            self.clear()
        self.learn([w for w in vocabulary if w not in self.index])
        index = self.index
        at = np.fromiter((index[w] for w in vocabulary), np.int64, len(vocabulary))[coded.indices.to_numpy(zero_copy_only=False)]
        starts, lengths = self.offsets[at], self.offsets[at + 1] - self.offsets[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
        ids = self.flat[source]
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        offsets = np.concatenate([[0], ends])[bounds]
        if special.any():
            parts = [ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            for i in np.flatnonzero(special):
                parts[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One tokenizer for all tasks of a Python worker, so that none is read while another is still held."""
    return WordIds(path)


def pieces_of(path: str, size: int, end_id: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                ids, offsets = words.encode(part.column("text"))
                lengths = np.diff(offsets) + 1
                cuts = -(-lengths // size)
                row = np.repeat(np.arange(len(lengths)), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * size
                length = np.minimum(size, lengths[row] - start)
                last = start + length == lengths[row]
                end = np.array([end_id], "<u4").tobytes()
                crc, kept = np.empty(len(row), np.int64), []
                view = ids.astype("<u4").tobytes()
                for k, (a, b, z) in enumerate(zip(offsets[row] + start, offsets[row] + start + length - last, last, strict=True)):
                    data = view[4 * a : 4 * b] + (end if z else b"")
                    crc[k] = zlib.crc32(data)
                    if with_ids:
                        kept.append(np.frombuffer(data, "<u4").astype(np.int32))
                out = [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def cut_documents(documents: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Token pieces of every whole text (null: empty), each at most `size` long; `end_id` ends a document."""
    small_batches(documents.sparkSession)
    kind = PIECE + (", ids array<int>" if with_ids else "")
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces_of(tokenizer, size, end_id, with_ids), kind)


def sum_of_squares(lengths: np.ndarray, size: int, early: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A bin and an offset in it for each length, placed one by one in the given order.

    counts[g] is the number of open bins with gap g. An item goes where the sum of the squared counts
    becomes smallest, into a gap that holds it or into a new bin; on a tie the smallest gap wins, and a
    new bin comes last. Full bins count no more. Unless `early`, a new bin is begun only for an item that no
    open bin holds.
    """
    counts = np.zeros(size + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    used: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, x in enumerate(lengths.tolist()):
        chosen = -1
        if x < size:
            # squares change by 2 * (counts[gap - x] - counts[gap]) + 2; a gap that closes has no count after it
            after = counts[: size - x].copy()
            after[0] = 0
            change = 2 * (after - counts[x:size]) + 2
            change[0] -= 1
            change[counts[x:size] == 0] = 1 << 60
            best = int(np.argmin(change)) if len(change) else 0
            new = 2 * counts[size - x] + 1
            if len(change) and (change[best] <= new or not early and change[best] < 1 << 59):
                chosen = best + x
        if chosen < 0:
            number, gap = len(used), size
            used.append(0)
        else:
            number, gap = open_bins[chosen].pop(), chosen
            counts[chosen] -= 1
        where[i], offset[i] = number, used[number]
        used[number] += x
        if gap - x:
            counts[gap - x] += 1
            open_bins[gap - x].append(number)
    return where, offset


def pack_group(size: int) -> Callable[[pa.Table], pa.Table]:
    """Places for the rows of one group, longest first; the ids stay where they are in the group's Arrow buffers."""

    def run(rows: pa.Table) -> pa.Table:
        doc, piece, crc, length, grp = (pc.fill_null(rows.column(c), 0).to_numpy() for c in ("doc_id", "piece", "ids_crc32", "length", "grp"))
        order = np.lexsort((crc, piece, doc, -length))
        where, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        # the rule with and without early bins; the one that needs fewer is kept, on a tie the former
        where[order], offset[order] = min((sum_of_squares(length[order], size, early) for early in (True, False)), key=lambda placed: placed[0].max(initial=-1))
        places = pa.array((grp.astype(np.int64) << 32) + where), pa.array(offset)
        return rows.drop_columns("grp").append_column("sequence_id", places[0]).append_column("offset", places[1])

    return run


def pack_documents(documents: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most `size` tokens, by the sum-of-squares rule.

    Only documents longer than `size` are cut. Pieces are dealt row by row, whatever their ids, into groups
    of about GROUP_ROWS documents and GROUP_BYTES of text, and each group is packed by itself, longest
    first, by the rule with new sequences begun early and with new ones only for pieces that no open one
    holds; the better of both is kept. So the work spreads over the cluster, null or repeated ids as well, and no
    task sees more than its group. Rarely does a group need more sequences than its tokens fill.

    Null and empty texts have their end token alone. Rows that repeat are packed each. A null doc_id is
    kept. An empty table gives no rows. Other columns are ignored. Returns doc_id, piece, start, length,
    ids_crc32, sequence_id, offset and, `with_ids`, ids.
    """
    pieces = cut_documents(documents, tokenizer, size, end_id, with_ids)
    size_of = documents.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")).first()
    groups = max(1, -(-size_of["n"] // GROUP_ROWS), -(-(size_of["bytes"] or 0) // GROUP_BYTES))
    # the number of a row in its task, which a repeated task gives again
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    kind = PIECE + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return pieces.groupBy("grp").applyInArrow(pack_group(size), kind)
