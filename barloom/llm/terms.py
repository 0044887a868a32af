"""Words of whole texts as dictionary codes, a batch at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from barloom.llm.common import utf8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes outside the given ASCII ranges (ends inclusive): those that words are made of. Bytes of other characters all count."""
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


#: `[^\x20\x09-\x0D]+`
NOT_BLANK = byte_class((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of texts with A-Z lowered; in the unlowered bytes A-Z count too
LETTERS_AND_DIGITS = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`
LETTERS = byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def word_codes(column: pa.Array, word: np.ndarray, lower: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of a string column in order: their codes, the distinct words that the codes stand for, and for
    each text the number of its first word (n + 1 entries). Null texts have none; a word ends where its text ends.

    `word` tells the bytes that words are made of; `lower` lowers A-Z. Words are compared whole, not by a hash.
    """
    data, offsets = utf8(column)
    inside = word[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | border[1:-1]
    ends[:-1] &= ~inside[1:] | border[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    first = np.searchsorted(starts, offsets)
    packed = data[inside]
    if lower:
        packed = _LOWER[packed]
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts + 1, out=places[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(packed)))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, first
