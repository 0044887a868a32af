"""Personal data: base patterns, and more spans by aggregation of weak labelers. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch

#: Base patterns. Possessive steps and the look behind keep Java's matcher linear on long runs; matches are those of the
#: plain patterns, as a run's later starts meet the same end as its first, or follow the last match (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
BASE = tuple(PATTERNS)
#: Candidates of further kinds: digit groups, and long strings of letters and digits.
CANDIDATES = {
    "number": r"(?<![A-Za-z0-9.+-])[0-9](?:[ -]?[0-9]){8,}+(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{12,}+",
}
ADDED = tuple(CANDIDATES)
#: Texts without this cannot match; a cheap test that spares most texts the search.
NEEDED = {"email": "@[A-Za-z0-9-]+[.]", "ip": r"[0-9][.][0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"[+][0-9]", "number": "[0-9][ -]?[0-9]", "secret": "[0-9]"}
#: The gazetteer: whole words that announce personal or secret data.
GAZETTEER = "(?i)(?<![a-z])(?:token|secret|password|passwd|pwd|api[_ -]?key|key|credential|auth|bearer|account|iban|ssn|social security|passport|licen[cs]e|phone|mobile|fax|tel|call|card|contact|e?mail|id)s?(?![a-z])"
CONTEXT_CHARS = 24
#: They look at different things: the layout of the characters, the words before, the signs before, the length, and for numbers
#: the check digit of a card or for secrets how letters and digits mix.
LABELERS = ("shape", "gazetteer", "context", "length", "inner")
CLUES = ("secret", "digits_heavy", "quoted", "assigned", "announced", "long", "grouped", "upper", "no_card")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """Running folds of an array by an associative step whose neutral value is `zero`, in blocks, so that long arrays stay cheap."""
    grow = lambda seen, x: F.concat(seen, F.array(op(F.element_at(seen, -1), x)))
    none = F.lit([]).cast("array<bigint>")

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: F.slice(v, b * block + 1, block))

    def folds(parts: Column) -> Column:
        firsts = F.aggregate(F.transform(parts, lambda p: F.aggregate(p, zero, op)), F.array(zero), grow)
        return let(firsts, lambda f: F.flatten(F.transform(parts, lambda p, i: F.slice(F.aggregate(p, F.array(F.get(f, i)), grow), 2, block))))

    return F.when(F.size(values) == 0, none).otherwise(let(values, lambda v: let(blocks(v), folds)))


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Running sums of an array of longs."""
    return running(values, F.lit(0).cast("bigint"), lambda a, x: a + x, block)


def prefix_tops(values: Column, least: int = 0) -> Column:
    """Running maxima of an array of longs, `least` at least."""
    return running(values, F.lit(least).cast("bigint"), lambda a, x: F.greatest(a, x))


def matches(text: Column, pattern: str, needed: str, context: int = 0) -> Column:
    """All matches of a pattern, left to right, as structs of start, end (code points, end exclusive) and the text m.

    With `context`, also the `before` of each: that many code points before it. They are put together from the pieces between the
    matches, not cut from the text, which would be walked from its start for each match; the three matches before and
    the pieces between them hold all of it if a match has a third of the context at least.
    """
    none = F.lit([]).cast(f"array<struct<start:bigint,end:bigint,m:string{',before:string' if context else ''}>>")

    def placed(found: Column, between: Column) -> Column:
        last = lambda x: F.right(F.coalesce(x, F.lit("")), F.lit(context))
        back = lambda i: [last(F.get(x, i - k)) for k in (3, 2, 1, 0) for x in ((between, found) if k else (between,)) if not (k == 3 and x is between)]
        before = lambda i: [F.right(F.concat(*back(i)), F.lit(context)).alias("before")] if context else []
        steps = F.transform(found, lambda m, i: (F.length(F.get(between, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0)).cast("bigint"))
        return let(prefix_sums(steps), lambda s: F.transform(found, lambda m, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(m)).alias("end"), m.alias("m"), *before(i))))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda b: placed(f, b))))
    return F.when(text.rlike(needed), found).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    def total(d: Column) -> Column:
        def value(i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0

    return let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), total(d)).otherwise(False))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda x: let(F.regexp_replace(x, "^0+", ""), lambda y: (F.length(y) <= 3) & (F.coalesce(F.when(F.length(y) <= 3, y.try_cast("int")), F.lit(0)) <= 255))
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Start and end of the matches of a base kind that hold; those that fail are dropped, without a retry."""
    kept = F.filter(matches(text, PATTERNS[kind], NEEDED[kind]), lambda s: _valid(kind, s["m"]))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def candidates(text: Column, kind: str) -> Column:
    """Candidates of a further kind, with the labelers' votes (1 for, -1 against, 0 none) and the classifier's clues."""

    def judged(s: Column) -> Column:
        m = s["m"]
        digits, size = F.length(_digits(m)), F.length(m)

        def rate(b: Column) -> Column:
            hexed = m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
            grouped = m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[0-9]{3,4}([ -][0-9]{3,4}){2,}$")
            plain = m.rlike("^[0-9]+$")
            announced, quoted, assigned = b.rlike(GAZETTEER), b.rlike("[\"'`]$"), b.rlike("[=:][ \"'`]*$")
            heavy = digits * 2 > size
            mixed = (digits * 10 >= size) & (digits * 10 <= size * 9)
            vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
            broken = F.lit(kind == "number") & plain & digits.between(13, 19)  # a bare card number whose check digit held would be a base span
            shape = vote(hexed & (size >= 20), ~hexed & ~m.rlike("[0-9].*[A-Za-z].*[0-9]")) if kind == "secret" else vote(grouped, ~grouped & ~plain)
            length = vote(size.between(20, 128), size < 16) if kind == "secret" else vote(digits.between(9, 12), digits > 19)
            inner = vote(mixed, ~mixed) if kind == "secret" else vote(F.lit(False), broken)
            votes = (shape, vote(announced, F.lit(False)), vote(quoted | assigned, b.rlike("[A-Za-z,.]$")), length, inner)
            clues = (F.lit(kind == "secret"), heavy, quoted, assigned, announced, size >= 20, grouped, m.rlike("[A-Z]"), broken)
            return F.struct(
                s["start"].alias("start"), s["end"].alias("end"),
                F.array(*[v.cast("int") for v in votes]).alias("votes"), F.array(*[c.cast("int") for c in clues]).alias("clues"),
            )

        return let(s["before"], rate)

    return F.transform(matches(text, CANDIDATES[kind], NEEDED[kind], CONTEXT_CHARS), judged)


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """The share of real spans and each labeler's chance of each vote for real and other spans, by expectation-maximisation.

    It starts from the majority vote. Every chance has a small prior, so a vote that was never seen says little.
    """
    if not patterns:
        return 0.5, [{v: (1 / 3, 1 / 3) for v in (-1, 0, 1)} for _ in LABELERS]
    real = [1 / (1 + math.exp(-sum(votes))) for votes, _ in patterns]
    prior, chance = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        yes = sum(p * n for p, (_, n) in zip(real, patterns, strict=True))
        prior = (yes + 1) / (total + 2)
        chance = []
        for k in range(len(LABELERS)):
            seen = {v: [0.5, 0.5] for v in (-1, 0, 1)}
            for p, (votes, n) in zip(real, patterns, strict=True):
                seen[votes[k]][0] += p * n
                seen[votes[k]][1] += (1 - p) * n
            sums = [sum(x[i] for x in seen.values()) for i in (0, 1)]
            chance.append({v: (x[0] / sums[0], x[1] / sums[1]) for v, x in seen.items()})
        real = [posterior(prior, chance, votes) for votes, _ in patterns]
    return prior, chance


def posterior(prior: float, chance: list[dict[int, tuple[float, float]]], votes: tuple[int, ...]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(c[v][0] / c[v][1]) for c, v in zip(chance, votes, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def fit_classifier(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Logistic weights (a bias first) from clue patterns with their numbers of spans and their share of real ones."""
    weights = [0.0] * (len(CLUES) + 1)
    total = sum(n for _, n, _ in rows) or 1.0
    for _ in range(rounds):
        step = [-ridge * w for w in weights]
        for clues, n, share in rows:
            x = (1, *clues)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * v for w, v in zip(weights, x, strict=True))))))
            for i, v in enumerate(x):
                step[i] += (share - p) * v * n / total
        weights = [w + rate * s for w, s in zip(weights, step, strict=True)]
    return weights


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities of the labelers and the weights of the final span classifier."""

    prior: float
    chance: list[dict[int, tuple[float, float]]]
    weights: list[float]

    def accepts(self, clues: Column) -> Column:
        total = F.lit(self.weights[0])
        for i, w in enumerate(self.weights[1:]):
            total = total + F.get(clues, F.lit(i)) * F.lit(w)
        return total >= 0


def fit(found: DataFrame) -> SpanModel:
    """Fit on all candidates: their vote and clue patterns are counted by Spark, and the driver sees the patterns only.

    There are at most 3 ** 5 votes and 2 ** 9 clues, whatever the input.
    """
    each = found.select(F.explode(F.concat(*[F.col(f"more_{k}") for k in ADDED])).alias("s")).select("s.votes", "s.clues")
    counted = [(tuple(r["votes"]), tuple(r["clues"]), r["n"]) for r in each.groupBy("votes", "clues").agg(F.count("*").alias("n")).orderBy("votes", "clues").collect()]
    votes: dict[tuple[int, ...], float] = {}
    for v, _, n in counted:
        votes[v] = votes.get(v, 0) + n
    prior, chance = estimate(sorted(votes.items()))
    clues: dict[tuple[int, ...], list[float]] = {}
    for v, c, n in counted:
        own = clues.setdefault(c, [0.0, 0.0])
        own[0] += n
        own[1] += n * posterior(prior, chance, v)
    return SpanModel(prior, chance, fit_classifier([(c, n, real / n) for c, (n, real) in sorted(clues.items())]))


def find(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base spans of each kind, candidates of further kinds, and the columns `keep`, for every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long"), *keep,
        *[base_spans(text, k).alias(f"base_{k}") for k in BASE],
        *[candidates(text, k).alias(f"more_{k}") for k in ADDED],
    )


def added(model: SpanModel, kind: str) -> Column:
    """The accepted candidates of a kind that no base span overlaps.

    Base spans and candidates stand in one order; the furthest end of the base spans before a candidate and
    the nearest start of those behind it tell whether it is free, so many spans cost their number, not its square.
    """
    none = F.lit([]).cast("array<struct<start:bigint,end:bigint>>")
    far = 1 << 60
    entry = lambda s, cand, ok: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(cand).alias("cand"), ok.alias("ok"))
    taken = F.transform(F.concat(*[F.col(f"base_{k}") for k in BASE]), lambda b: entry(b, 0, F.lit(False)))
    own = F.transform(F.col(f"more_{kind}"), lambda s: entry(s, 1, model.accepts(s["clues"])))

    def free(rows: Column) -> Column:
        before = prefix_tops(F.transform(rows, lambda x: F.when(x["cand"] == 0, x["end"]).otherwise(0)))
        behind = F.reverse(prefix_tops(F.transform(F.reverse(rows), lambda x: F.when(x["cand"] == 0, -x["start"]).otherwise(-far)), -far))
        kept = lambda a, z: F.filter(rows, lambda x, i: (x["cand"] == 1) & x["ok"] & (F.get(a, i) <= x["start"]) & (-F.get(z, i) >= x["end"]))
        return let(before, lambda a: let(behind, lambda z: F.transform(kept(a, z), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    return F.when(F.size(F.col(f"more_{kind}")) == 0, none).otherwise(let(F.array_sort(F.concat(taken, own)), free))


def detect(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Personal data in every whole text: arrays of start and end for each of the base and added kinds.

    Base spans are exactly the base patterns' matches. Labelers (shape, gazetteer, context, length,
    mixture) vote on further candidates; expectation-maximisation over all candidates estimates how
    reliable they are; its posteriors train the final classifier, which decides. Texts are searched once:
    the narrow result is checkpointed between the fit and the decision.

    Null and empty texts have no spans. Rows that repeat are searched each; a null doc_id is kept; an
    empty table gives no rows. Other columns are ignored but for `keep`, whose names must not clash with
    those returned: doc_id and one array column for each kind in BASE and ADDED.
    """
    with Scratch(documents.sparkSession) as t:
        found = t.keep("found", find(documents, keep))
    model = fit(found)
    return found.select("doc_id", *keep, *[F.col(f"base_{k}").alias(k) for k in BASE], *[added(model, k).alias(k) for k in ADDED])


def written(kinds: tuple[str, ...]) -> Column:
    """All spans of the kinds as kind:start:end, by kind and start, comma-joined."""

    def parts(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(parts, kinds)), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the spans of each kind, and their places as text, from what `detect` returns, row by row."""
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(written(BASE), 256).alias("base_sha256"), written(BASE + ADDED).alias("spans"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ADDED],
    )


def redact(documents: DataFrame) -> DataFrame:
    """The documents with every span of their texts replaced by its kind in capitals, in brackets; n_chars follows.

    Of spans that overlap, the one that begins first stands for all it overlaps. Null texts stay null and
    empty ones empty. Rows that repeat are redacted each; null ids stay; an empty table gives no rows; all
    columns are kept. The work is linear in a text's length and in its number of spans.
    """
    names = tuple(c for c in documents.columns if c != "doc_id")
    packed = documents.select("doc_id", "text", F.struct(*names).alias("row_")) if names else documents
    found = detect(packed, ("row_",))

    def tags(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("tag")))

    spans = F.array_sort(F.concat(*[tags(k) for k in BASE + ADDED]))
    text = F.col("row_")["text"]

    def rebuilt(chunks: Column, size: Column, s: Column, reach: Column) -> Column:
        """The text between the furthest end so far and each span that begins no earlier, and that span's tag."""
        zero = F.lit(0).cast("bigint")

        def piece(start: Column, end: Column) -> Column:
            first = F.floor(start / size)
            held = F.slice(chunks, (first + 1).cast("int"), (F.floor((end - 1) / size) - first + 1).cast("int"))
            return F.when(end <= start, "").otherwise(F.substring(F.array_join(held, ""), (start - first * size + 1).cast("int"), (end - start).cast("int")))

        before = lambda i: F.when(i == 0, zero).otherwise(F.get(reach, i - 1))
        parts = F.transform(s, lambda x, i: F.when(x["start"] >= before(i), F.concat(piece(before(i), x["start"]), x["tag"])).otherwise(""))
        return F.concat(F.array_join(parts, ""), piece(F.element_at(reach, -1), F.length(text).cast("bigint")))

    def changed(s: Column) -> Column:
        size = F.greatest(F.lit(2048), F.floor(F.length(text) / 256)).cast("bigint")
        chunks = lambda c: F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((F.length(text) - 1) / c)), lambda k: F.substring(text, (k * c + 1).cast("int"), c.cast("int")))
        reach = prefix_tops(F.transform(s, lambda x: x["end"]))
        return let(size, lambda c: let(chunks(c), lambda parts: let(reach, lambda r: rebuilt(parts, c, s, r))))

    new = F.when(text.isNull(), F.lit(None).cast("string")).otherwise(let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(changed(s))))
    out = found.select("doc_id", "row_", new.alias("text_"))
    columns = []
    for c in documents.columns:
        if c == "doc_id":
            columns.append(F.col("doc_id").cast(documents.schema["doc_id"].dataType).alias("doc_id"))
        elif c == "text":
            columns.append(F.col("text_").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("row_")["n_chars"].isNotNull(), F.length("text_")).cast(documents.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col("row_")[c].alias(c))
    return out.select(*columns)
