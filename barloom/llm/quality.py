"""A quality classifier by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import mix, slices, small_batches, training_rows, utf8, words_of

#: Most labelled documents of each class from which the model is fitted.
TRAIN_PER_CLASS = 1500
#: Code points of a training document that the fit sees; longer ones give evenly spread pieces.
TRAIN_CHARS = 60_000
PASSAGE_WORDS = 64
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE = 24, 12, 25, 64, 0.01

#: Classes of bytes: 0 small vowel, 1 other small letter, 2 capital, 3 digit, 4 blank, 5 line feed, 6 sentence mark,
#: 7 exclamation or question mark, 8 quote or bracket, 9 other sign, 10 byte of a longer character, 11 control.
_CLASSES = np.full(256, 9)
for _k, _which in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", bytes(range(65, 91)), b"0123456789", b" \t", b"\n\r\v\f", b".,;:-", b"!?", b"\"'()[]{}<>")):
    _CLASSES[list(_which)] = _k
_CLASSES[128:] = 10
_CLASSES[list(range(0, 9)) + [127]] = 11
CLASSES = 12
FEATURES = CLASSES + CLASSES * CLASSES + 5


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts in a row, and the texts' numbers of passages (one at least).

    A passage is PASSAGE_WORDS words. Features: parts of byte classes and of their pairs, the part of
    distinct words and of words that repeat their forerunner, mean word length, length, bytes a line.
    """
    data, offsets = utf8(column)
    starts, ends, hashes, first = words_of(data, offsets)
    per_text = np.diff(first)
    number = np.maximum(1, -(-per_text // PASSAGE_WORDS))
    base = np.cumsum(number) - number
    total = int(number.sum())
    text_of_word = np.repeat(np.arange(len(per_text)), per_text)
    of_word = base[text_of_word] + (np.arange(len(starts)) - first[text_of_word]) // PASSAGE_WORDS
    # a byte belongs to the passage of the last word that began before it, in its own text
    steps = np.zeros(len(data) + 1, np.int64)
    begin = np.concatenate([[True], of_word[1:] != of_word[:-1]]) if len(of_word) else np.empty(0, bool)
    inner = begin & (np.arange(len(starts)) != first[text_of_word]) if len(of_word) else begin
    steps[starts[inner]] = 1
    text_of_byte = np.repeat(np.arange(len(per_text)), np.diff(offsets))
    within = np.cumsum(steps[:-1])
    before = np.concatenate([[0], within])[offsets[:-1]]
    of_byte = base[text_of_byte] + within - before[text_of_byte]
    kind = _CLASSES[data]
    single = np.bincount(of_byte * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES).astype(np.float32)
    pairs = np.zeros((total, CLASSES * CLASSES), np.float32)
    if len(data) > 1:
        same = of_byte[1:] == of_byte[:-1]
        pairs = np.bincount((of_byte[:-1] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:])[same], minlength=total * CLASSES * CLASSES).reshape(total, -1).astype(np.float32)
    size = np.maximum(1, single.sum(axis=1, keepdims=True))
    n_words = np.maximum(1, np.bincount(of_word, minlength=total))
    distinct = np.zeros(total)
    if len(starts):
        keys = np.unique(mix(hashes + of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) // np.uint64(total) * np.uint64(total) + of_word.astype(np.uint64))
        distinct = np.bincount((keys % np.uint64(total)).astype(np.int64), minlength=total)
    again = np.zeros(total)
    if len(starts) > 1:
        again = np.bincount(of_word[1:][(hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])], minlength=total)
    letters = np.bincount(of_word, (ends - starts).astype(float), minlength=total)
    extra = np.stack([distinct / n_words, again / n_words, letters / n_words / 10, n_words / PASSAGE_WORDS, np.log1p(size[:, 0] / (1 + single[:, 5])) / 6], axis=1)
    return np.concatenate([single / size, pairs / size, extra], axis=1, dtype=np.float32), number


class AttentionModel:
    """Passage encoder, gated attention, and the score of the attended representation."""

    NAMES = ("w", "b", "v", "u", "a", "c", "d")

    def __init__(self, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        scale = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.spread = np.zeros(FEATURES), np.ones(FEATURES)
        self.w, self.b = scale(FEATURES, HIDDEN), np.zeros(HIDDEN)
        self.v, self.u, self.a = scale(HIDDEN, ATTENTION), scale(HIDDEN, ATTENTION), scale(ATTENTION, 1)[:, 0]
        self.c, self.d = np.zeros(HIDDEN), np.zeros(1)

    def forward(self, x: np.ndarray, number: np.ndarray) -> dict[str, np.ndarray]:
        """x: standardised passage features in a row; number: passages of each document."""
        start = np.cumsum(number) - number
        h = np.tanh(x @ self.w + self.b)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * g) @ self.a
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), number))
        attention = e / np.repeat(np.add.reduceat(e, start), number)
        z = np.add.reduceat(attention[:, None] * h, start)
        return {"h": h, "t": t, "g": g, "attention": attention, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))}

    def gradients(self, x: np.ndarray, number: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Mean gradients of the log loss."""
        f, start = self.forward(x, number), np.cumsum(number) - number
        h, t, g, at = f["h"], f["t"], f["g"], f["attention"]
        delta = (f["p"] - y) / len(y)
        dz = np.repeat(delta[:, None] * self.c, number, axis=0)
        da = (dz * h).sum(axis=1)
        de = at * (da - np.repeat(np.add.reduceat(at * da, start), number))
        dtg = de[:, None] * self.a
        dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
        dh = (at[:, None] * dz + dt @ self.v.T + dg @ self.u.T) * (1 - h**2)
        return {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": delta @ f["z"], "d": np.array([delta.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 0) -> AttentionModel:
        """Adam over shuffled batches of documents."""
        whole = np.concatenate(bags)
        self.mean, self.spread = whole.mean(axis=0), whole.std(axis=0) + 1e-3
        bags = [(x - self.mean) / self.spread for x in bags]
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        second = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        step = 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                step += 1
                g = self.gradients(np.concatenate([bags[j] for j in part]), np.array([len(bags[j]) for j in part]), y[part])
                for k in self.NAMES:
                    own = getattr(self, k)
                    grad = g[k] + 1e-4 * own
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad**2
                    own -= RATE * (0.3 if epoch > 0.7 * EPOCHS else 1) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents, and the attention weight of the most attended passage of each."""
        f = self.forward((x - self.mean) / self.spread, number)
        return f["p"], np.maximum.reduceat(f["attention"], np.cumsum(number) - number)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x, number = passages(part.column("text"))
            ends = np.cumsum(number)
            rows = [x[b - n : b].astype("<f4").tobytes() for b, n in zip(ends, number, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("order"), part.column("label"), pa.array(rows, pa.binary())], ["order", "label", "x"])


def fit(documents: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> AttentionModel:
    """Fit on at most `per_class` labelled documents of each class that are not held out.

    Their passages are encoded on the executors; the driver gets numbers only, of TRAIN_CHARS code points a
    document. With no rows of a class the model stays undecided (0.5).
    """
    small_batches(documents.sparkSession)
    rows = training_rows(documents, labels, "quality", per_class, TRAIN_CHARS)
    got = rows.select("order", "label", "text").mapInArrow(_featurise, "order long, label int, x binary").toLocalIterator()
    bags, y = [], []
    for row in sorted(got, key=lambda row: row["order"]):
        bags.append(np.frombuffer(row["x"], "<f4").reshape(-1, FEATURES).astype(np.float64))
        y.append(row["label"])
    model = AttentionModel()
    return model.fit(bags, np.array(y, float)) if len(set(y)) == 2 else model


SCORED = "doc_id long, score double, attention double"


def score(documents: DataFrame, model: AttentionModel) -> DataFrame:
    """A quality score of every whole text, and the largest attention weight of its passages.

    Null and empty texts have one empty passage. Rows that repeat are scored each; a null doc_id is kept;
    an empty table gives no rows; other columns are ignored. The model's size is fixed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p, most = model.score(*passages(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array(most)], ["doc_id", "score", "attention"])

    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, SCORED)


def accepted(documents: DataFrame, model: AttentionModel, least: float) -> DataFrame:
    """The rows whose score is `least` or more, with all their columns, as Arrow batches in parts.

    Rows are judged one by one, so rows that repeat, null ids and clashing names of other columns matter not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(model.score(*passages(part.column("text")))[0] >= least))

    small_batches(documents.sparkSession)
    return documents.mapInArrow(run, documents.schema)
