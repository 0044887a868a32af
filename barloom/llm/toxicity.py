"""Toxic spans by a linear-chain conditional random field over word tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import runs_of, small_batches, training_rows

#: Most labelled documents of each class from which the model is fitted.
TRAIN_PER_CLASS = 1500
#: Code points of a training document that the fit sees; longer ones give evenly spread pieces.
TRAIN_CHARS = 60_000
#: Weights nearer to 0 are dropped from the fitted model.
LEAST_WEIGHT = 0.02
#: Code points of text whose chains a task walks side by side.
BATCH_CHARS = 12 << 20
#: Token windows in training: words on either side of a labelled token, and how many plain windows a document gives.
WINDOW, PLAIN_WINDOWS = 6, 6
EPOCHS, RATE, L2 = 12, 0.5, 1e-6
#: Words whose emission score a task keeps.
CACHE_WORDS = 400_000
SPAN_AT = 0.5

tokens = re.compile(r"\w+").findall
spans = re.compile(r"\w+").finditer


def features(word: str) -> tuple[str, ...]:
    """Features of a lower-case token: a constant, the word, its first letters (^) and its last ones ($)."""
    return ("", word + "^$", word[:3] + "^", word[:4] + "^", word[:5] + "^", word[:6] + "^", word[-3:] + "$", word[-4:] + "$")


def token_labels(documents: list[list[str]], labels: list[int]) -> Callable[[str], bool]:
    """Which tokens are toxic, learnt from labelled documents: those whose word or stem marks toxic documents.

    A word, or a stem of 4 to 6 first letters, is a mark if it stands in 4 toxic documents at least and,
    per document, 20 times as often in toxic ones as in others.
    """
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for words, label in zip(documents, labels, strict=True):
        lower = set(words)
        seen[label].update(lower)
        seen[label].update({f"{w[:n]}\0" for w in lower for n in (4, 5, 6) if len(w) > n})
    totals = [max(1, labels.count(k)) for k in (0, 1)]
    marks = {m for m, n in seen[1].items() if n >= 4 and n / totals[1] >= 20 * (seen[0][m] + 0.25) / totals[0]}

    def toxic(w: str) -> bool:
        return w in marks or any(f"{w[:n]}\0" in marks for n in (4, 5, 6) if len(w) > n)

    return toxic


def marginals(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(token is toxic) for chains that stand in a row, by forward-backward.

    scores: log-odds of each token's own features. transition: log potentials from label to label. Two
    labels need only the ratio of the two messages; the chains step side by side, longest first.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    odds = np.exp(np.clip(scores, -30, 30))
    t = np.exp(transition)
    alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0] + 1 if len(sizes) else 1), side="right")
    forward, backward = np.empty(len(scores)), np.ones(len(scores))
    ratio = np.ones(0)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        at = starts[: alive[step]] + step
        ratio = odds[at] if not step else odds[at] * (t[0, 1] + ratio[: len(at)] * t[1, 1]) / (t[0, 0] + ratio[: len(at)] * t[1, 0])
        forward[at] = ratio
    ends = starts + sizes - 1
    ratio = np.ones(len(sizes))
    for step in range(1, int(sizes[0]) if len(sizes) else 0):
        n = alive[step]
        after = ends[:n] - step + 1
        carried = odds[after] * ratio[:n]
        ratio = (t[1, 0] + carried * t[1, 1]) / (t[0, 0] + carried * t[0, 1])
        backward[ends[:n] - step] = ratio
    whole = forward * backward
    return whole / (1 + whole)


def windows(documents: list[list[str]], toxic: Callable[[str], bool]) -> list[tuple[list[str], list[int]]]:
    """Training chains: the surroundings of toxic tokens, and evenly spread plain windows of every document."""
    out = []
    width = 2 * WINDOW + 1
    for words in documents:
        marked = [i for i, w in enumerate(words) if toxic(w)]
        at = {max(0, i - WINDOW) for i in marked[:: max(1, len(marked) // PLAIN_WINDOWS)]}
        at |= {i for i in range(0, len(words), max(width, len(words) // PLAIN_WINDOWS))}
        for i in sorted(at):
            part = words[i : i + width]
            out.append((part, [int(toxic(w)) for w in part]))
    return out


def fit_chain(chains: list[tuple[list[str], list[int]]]) -> tuple[dict[str, float], np.ndarray]:
    """Weights of label 1's features and 2 x 2 transitions that maximise the chains' likelihood (AdaGrad)."""
    number: dict[str, int] = {}
    known: dict[str, list[int]] = {}
    flat = []
    for words, _ in chains:
        for w in words:
            if w not in known:
                known[w] = [number.setdefault(x, len(number)) for x in features(w)]
            flat.append(known[w])
    per_token = len(features(""))
    flat = np.array(flat, np.int64).reshape(-1)
    gold = np.array([y for _, labels in chains for y in labels], float)
    owner = np.repeat(np.arange(len(gold)), per_token)
    lengths = np.array([len(words) for words, _ in chains], np.int64)
    starts = np.cumsum(lengths) - lengths
    weights, transition = np.zeros(len(number)), np.zeros((2, 2))
    past_w, past_t = np.full(len(number), 1e-6), np.full((2, 2), 1e-6)
    inner = np.ones(len(gold), bool)
    inner[starts] = False
    after = np.flatnonzero(inner)
    n = len(gold)
    for _ in range(EPOCHS):
        scores = np.bincount(owner, weights[flat], minlength=n)
        p = marginals(scores, lengths, transition)
        step = np.bincount(flat, (gold - p)[owner], minlength=len(number)) / n - L2 * weights
        past_w += step**2
        weights += RATE * step / np.sqrt(past_w)
        # pair marginals of neighbours, from the tokens' marginals and the potentials between them
        t = np.exp(transition)
        a, b = p[after - 1], p[after]
        pair = np.stack([(1 - a) * (1 - b) * t[0, 0], (1 - a) * b * t[0, 1], a * (1 - b) * t[1, 0], a * b * t[1, 1]])
        pair /= pair.sum(axis=0)
        x, y = gold[after - 1], gold[after]
        real = np.stack([(1 - x) * (1 - y), (1 - x) * y, x * (1 - y), x * y])
        step_t = ((real - pair).sum(axis=1) / n).reshape(2, 2)
        past_t += step_t**2
        transition += RATE * step_t / np.sqrt(past_t)
    return {x: w for x, w in zip(number, weights.tolist(), strict=True) if abs(w) >= LEAST_WEIGHT}, transition


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each chain: bias, log-odds that any token is toxic, the highest marginal's log-odds, log length."""
    starts = np.cumsum(lengths) - lengths
    none = np.concatenate([[0.0], np.cumsum(np.log1p(-np.clip(p, 0, 1 - 1e-9)))])
    clean = none[starts + lengths] - none[starts]
    top = np.full(len(lengths), 1e-9)
    full = np.flatnonzero(lengths > 0)
    if len(full):
        top[full] = np.clip(np.maximum.reduceat(p, starts[full]), 1e-9, 1 - 1e-9)
    some = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
    return np.stack([np.ones(len(lengths)), np.log(some / (1 - some)), np.log(top / (1 - top)), np.log1p(lengths)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method for a ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) / len(y) - ridge * w)
        w += np.clip(step, -5, 5)
    return w


class Scores(dict):
    """Emission scores of words, worked out when first asked for."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights.get

    def __missing__(self, word: str) -> float:
        get = self.weights
        score = 0.0
        for x in features(word):
            score += get(x, 0.0)
        self[word] = score
        return score


class ToxicSpans:
    """A fitted model: token weights, transitions, and the step from marginals to a document's score."""

    def __init__(self, weights: dict[str, float], transition: np.ndarray, document: np.ndarray) -> None:
        self.weights, self.transition, self.document = weights, transition, document

    def chains(self, documents: Iterator[list[str]], known: Scores) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all tokens of the documents in a row, and the documents' numbers of tokens."""
        out, lengths = [], []
        for words in documents:
            out.append(np.fromiter(map(known.__getitem__, words), float, len(words)))
            lengths.append(len(words))
            if len(known) > CACHE_WORDS:
                known.clear()
        lengths = np.array(lengths, np.int64)
        return marginals(np.concatenate(out) if out else np.empty(0), lengths, self.transition), lengths

    def score(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(p, lengths) @ self.document, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> ToxicSpans:
    """Fit on at most `per_class` labelled documents of each class that are not held out.

    Their texts, of TRAIN_CHARS code points at most, reach the driver one by one and leave it as words; with
    fewer than one document of a class the model knows nothing and gives every text the same score.
    """
    rows = training_rows(documents, labels, "toxic", per_class, TRAIN_CHARS)
    words, marks = [], []
    for _, label, own in sorted((row["order"], row["label"], tokens(row["text"].lower())) for row in rows.toLocalIterator()):
        words.append(own)
        marks.append(label)
    if len(set(marks)) < 2:
        return ToxicSpans({}, np.zeros((2, 2)), np.zeros(4))
    # the chain learns from one half, the document's score from the other, so that it meets unseen texts
    half = len(words) // 2
    weights, transition = fit_chain(windows(words[:half], token_labels(words[:half], marks[:half])))
    model = ToxicSpans(weights, transition, np.zeros(4))
    p, lengths = model.chains(words[half:], Scores(weights))
    document = fit_logistic(summary(p, lengths), np.array(marks[half:], float))
    weights, transition = fit_chain(windows(words, token_labels(words, marks)))
    return ToxicSpans(weights, transition, document)


def joined_spans(text: str, hits: set[int]) -> list[list[int]]:
    """Starts and ends, in code points of the text, of the runs of tokens whose numbers are in `hits`."""
    # lower-casing can lengthen a text, so tokens are found as for the score and placed in the text itself
    low = text.lower()
    back = range(len(text) + 1) if len(low) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    parts: list[list[int]] = []
    for i, m in enumerate(spans(low)):
        if i in hits:
            start, end = back[m.start()], back[m.end() - 1] + 1
            if i - 1 in hits:
                parts[-1][1] = end
            else:
                parts.append([start, end])
    return parts


def gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches joined until they hold about BATCH_CHARS, so that many chains step side by side; null texts are empty."""
    held, size = [], 0
    for frame in frames:
        held.append(frame.assign(text=frame["text"].fillna("")))
        size += int(held[-1]["text"].str.len().sum())
        if size >= BATCH_CHARS:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


SCORED = "doc_id long, score double, n_spans int, spans string"


def score(documents: DataFrame, model: ToxicSpans) -> DataFrame:
    """A toxicity score of every whole text, and its toxic spans as start:end in code points, comma-joined.

    Adjoining toxic tokens are one span. Null and empty texts get the score of no tokens and no spans.
    Rows that repeat are scored each; a null doc_id is kept; an empty table gives no rows; other columns
    are ignored. The model holds the features of the bounded training windows, so each task carries it.
    """
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        known = Scores(own.weights)
        for frame in gathered(frames):
            for where in runs_of(frame["text"].tolist(), BATCH_CHARS):
                part = frame.iloc[where]
                texts = part["text"].tolist()
                p, lengths = own.chains((tokens(t.lower()) for t in texts), known)
                found, at = [], 0
                for text, n in zip(texts, lengths.tolist(), strict=True):
                    hits = set(np.flatnonzero(p[at : at + n] >= SPAN_AT).tolist())
                    at += n
                    found.append(joined_spans(text, hits) if hits else [])
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64"), "score": own.score(p, lengths), "n_spans": [len(x) for x in found],
                    "spans": [",".join(f"{s}:{e}" for s, e in x) for x in found],
                })

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(run, SCORED)
