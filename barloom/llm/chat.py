"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import utf8

BEGIN, TURN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
#: A backslash after its first character breaks a control string inside a text; a backslash itself is doubled.
ESCAPES = [("\\", "\\\\"), *((c, c[0] + "\\" + c[1:]) for c in (BEGIN, END, TURN, CLOSE))]
FORMATTED = "conv_id long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"


def escape(texts: pa.Array, role: bool = False) -> pa.Array:
    """Texts in which no control string stands; a role's line feeds are escaped too, as it ends at one."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for old, new in [*ESCAPES, *([("\n", "\\\n")] if role else [])]:
        texts = pc.replace_substring(texts, old, new)
    return texts


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def assemble(segments: list[tuple[np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the bytes of all segments in turn, in one buffer, and where each row's segments end.

    A segment column is bytes and offsets of its rows. Lengths give cumulative offsets, these the
    scatter indices by which each column is copied into its places at once.
    """
    lengths = np.stack([np.diff(offsets) for _, offsets in segments], axis=1) if rows else np.zeros((0, len(segments)), np.int64)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    out = np.empty(int(lengths.sum()), np.uint8)
    for j, (data, offsets) in enumerate(segments):
        size = lengths[:, j]
        shift = (ends[:, j] - size) - offsets[:-1]
        out[np.repeat(shift, size) + np.arange(len(data))] = data
    return out, ends


def constant(text: str, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A segment column that holds `text` in the rows where `where` is true, and nothing elsewhere."""
    data = np.frombuffer(text.encode(), np.uint8)
    return np.tile(data, int(where.sum())), np.concatenate([[0], np.cumsum(where * len(data))])


def code_points(data: np.ndarray) -> np.ndarray:
    """The number of code points that begin before each byte offset 0..n."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def format_rows(rows: pa.Table) -> pa.RecordBatch:
    """Whole conversations, ordered, to one formatted string and loss mask each."""
    ids = rows.column("conv_id").combine_chunks()
    missing = pc.is_null(ids).to_numpy(zero_copy_only=False)
    conv = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    n = len(conv)
    same = (conv[1:] == conv[:-1]) & (missing[1:] == missing[:-1])
    first = np.concatenate([[True], ~same])
    last = np.concatenate([~same, [True]])
    every = np.ones(n, bool)
    role, text = rows.column("role").combine_chunks(), rows.column("text").combine_chunks()
    segments = [
        constant(BEGIN, first), constant(TURN, every), utf8(escape(role, True)), constant("\n", every),
        utf8(escape(text)), constant(CLOSE, every), constant(END, last),
    ]
    data, ends = assemble(segments, n)
    count = code_points(data)
    where_last = np.flatnonzero(last)
    bounds = np.concatenate([[0], ends[where_last, -1]]).astype(np.int64)
    formatted = pa.LargeStringArray.from_buffers(len(where_last), pa.py_buffer(bounds), pa.py_buffer(data))
    learn = pc.fill_null(pc.equal(role, "assistant"), False).to_numpy(zero_copy_only=False)
    which = np.cumsum(first) - 1
    base = count[bounds[:-1]][which]
    start, end = count[ends[:, 3]] - base, count[ends[:, 4]] - base
    lists = np.concatenate([[0], np.cumsum(np.bincount(which[learn], minlength=len(where_last)))]).astype(np.int32)
    mask = [pa.ListArray.from_arrays(pa.array(lists), pa.array(x[learn])) for x in (start, end)]
    ids = ids.take(pa.array(where_last))
    turns = np.diff(np.concatenate([[-1], where_last]))
    return pa.RecordBatch.from_arrays([ids, pa.array(turns), formatted.cast(pa.string()), *mask], ["conv_id", "n_turns", "formatted", "loss_start", "loss_end"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []  # rows of a conversation that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id")
        last = ids[-1].as_py()
        cut = batch.num_rows
        while cut and ids[cut - 1].as_py() == last:
            cut -= 1
        if held and (cut or held[0].column("conv_id")[0].as_py() != last):
            whole = pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
            yield format_rows(whole)
        elif cut:
            yield format_rows(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
    if held:
        yield format_rows(pa.Table.from_batches(held))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One formatted string for each conversation, with the places of the assistant's texts in it.

    `<s>` begins and `</s>` ends a conversation; each turn is `[INST]`, its role, a line feed, its text and
    `[/INST]`. Control strings inside roles and texts are escaped reversibly. The loss mask is lists of
    starts and ends, in code points, of the texts of role `assistant`.

    Turns go by number (nulls first), then role and text. Null roles and texts are empty. Rows that repeat
    are turns of their own; rows with a null conv_id are one conversation. An empty table gives no rows;
    other columns are ignored. A task streams its conversations; only one conversation has to fit.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_format, FORMATTED)


_TURN = re.compile(r"\[INST\]((?:\\.|[^\\\n])*)\n((?:\\.|[^\\\[]|\[(?!/INST\]))*)\[/INST\]", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation; it must parse as a whole."""
    at, out = len(BEGIN), []
    while m := _TURN.match(formatted, at):
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if not formatted.startswith(BEGIN) or formatted[at:] != END:
        raise ValueError(f"not a formatted conversation at {at}")
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings and masks hold, read back from them alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv, text, starts, ends in zip(frame["conv_id"], frame["formatted"], frame["loss_start"], frame["loss_end"], strict=True):
                turns = read_back(text)
                learnt = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInPandas(run, DIGESTS)
