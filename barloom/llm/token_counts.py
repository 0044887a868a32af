"""Token counts by a Viterbi walk that keeps only the best score and the number of pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices, small_batches

#: What a unigram tokenizer subtracts from its lowest score for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Words whose count a task keeps.
CACHE_WORDS = 400_000


class UnigramCounter:
    """Numbers of pieces of words under a unigram vocabulary with byte fallback.

    An Aho-Corasick automaton yields all pieces that end at each position, longest first. Of paths with
    equal scores into a position the one met first in a left-to-right walk stays, that is the piece that
    begins first. A character without a piece of its own may also be unknown; it counts as its UTF-8
    bytes (all byte pieces must be in the vocabulary, else a run of unknown characters counts once).
    """

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, float] = {}
        for piece, score in vocabulary:
            if piece:
                pieces[piece] = score
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))

    def count(self, word: str) -> int:
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        counts = [0] * (n + 1)
        unknown_end = [False] * (n + 1)  # whether the best path ends with an unknown character
        best[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, found in self.automaton.iter(word):
            ends[last + 1].append(found)
        for i in range(1, n + 1):
            top, number, unknown = None, 0, False
            matches = sorted(ends[i], reverse=True)
            if word[i - 1] not in self.single:
                matches.append((0, self.unknown))
            for length, score in matches:
                start = i - (length or 1)
                total = best[start] + score
                if top is None or total > top:
                    top, unknown = total, not length
                    if length:
                        number = counts[start] + 1
                    elif self.bytes:
                        number = counts[start] + len(word[i - 1].encode("utf-8", "surrogatepass"))
                    else:
                        number = counts[start] + (not unknown_end[start])
            best[i], counts[i], unknown_end[i] = top, number, unknown
        return counts[n]


def piece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public piece model file, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def counts_of(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(piece_vocabulary(path))
        known: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pc.fill_null(part.column("text").cast(pa.large_string()), "")
                # the mark that stands for a blank begins a word where it is met, as a blank does
                words = pc.split_pattern(pc.replace_substring(texts, SPACE, " "), " ")
                coded = words.flatten().dictionary_encode()
                vocabulary = coded.dictionary.to_pylist()
                if len(known) > CACHE_WORDS:
                    known.clear()
                for w in vocabulary:
                    if w not in known:
                        known[w] = counter.count(SPACE + w)
                each = np.fromiter((known[w] for w in vocabulary), np.int64, len(vocabulary))[coded.indices.to_numpy(zero_copy_only=False)]
                bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))])
                total = np.concatenate([[0], np.cumsum(each)])[bounds]
                total = np.diff(total) - pc.starts_with(pc.replace_substring(texts, SPACE, " "), " ").to_numpy(zero_copy_only=False)
                total = np.where(pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0, 0, total)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64())], ["doc_id", "n_tokens"])

    return run


def count_tokens(documents: DataFrame, vocabulary: str) -> DataFrame:
    """The number of tokens of every whole text under a unigram vocabulary, without building the tokens.

    `vocabulary` is the path of a public piece model; its pieces and scores are read as a unigram model.
    A text's words begin at its blanks (a first word without one has a blank put before it) and are counted apart, as
    the tokenizer parts them. Null and empty texts have 0 tokens. Rows that repeat are counted each; a
    null doc_id is kept; an empty table gives no rows; other columns are ignored. Returns doc_id, n_tokens.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(counts_of(vocabulary), "doc_id long, n_tokens long")
