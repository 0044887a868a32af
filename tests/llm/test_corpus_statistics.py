"""Importance resampling, quality rules and the source audit against plain Python, and on empty, null, repeated and odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import divergence, quality_rules, resampling
from barloom.llm.terms import LETTERS, word_codes
from tests.llm.test_operators import docs, empty, odd, small, spread, texts_of  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


# ---- 11: importance resampling


def resampled(rows, target, least=20, percent=10):
    """rows: (doc_id, text) in the order of the table."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    s, t = (Counter(bucket(w) for x in texts for w in words(x)) for texts in ([x for _, x in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for i, (d, x) in enumerate(rows):
        weight = sum(gain(bucket(w)) for w in words(x))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(words(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, i])
    eligible = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    for rank, r in enumerate(eligible[: percent * len(eligible) // 100], 1):
        r[4] = rank
    return in_order(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("block", "span", "percent"), [(1000, 10_000, 10), (3, 20, 37), (1, 5, 100)])
def test_draw_is_that_of_a_full_sort(spark, small, monkeypatch, block, span, percent):  # noqa: F811
    monkeypatch.setattr(resampling, "BLOCK_ROWS", block)
    monkeypatch.setattr(resampling, "RANGE_ROWS", span)
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = resampling.resample(small.repartition(5), bench, percent=percent).collect()
    assert in_order(map(tuple, got)) == resampled(texts_of(small), [r["text"] for r in bench.collect()], percent=percent)


def test_draw_on_odd_rows(spark, odd, empty):  # noqa: F811
    bench = spark.createDataFrame([(1, "one Two three"), (2, None), (3, "")], "item_id long, text string")
    assert in_order(map(tuple, resampling.resample(odd, bench, least_words=0, percent=100).drop("rank").collect())) == in_order(r[:4] for r in resampled(texts_of(odd), ["one Two three"]))
    ranks = sorted(r["rank"] for r in resampling.resample(odd, bench, least_words=1, percent=50).collect() if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == sum(1 for r in resampled(texts_of(odd), []) if r[1] >= 1) // 2
    assert resampling.resample(empty, bench).count() == 0
    assert resampling.resample(odd, bench.where("false")).count() == odd.count()


def test_equal_rows_of_one_id_are_ranked_each(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 50)
    rows = docs(spark, ["the same words " * 10] * 400).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, 7).cast("long")).repartition(6)
    out = resampling.resample(rows, rows.limit(1), percent=50).collect()
    assert len(out) == 400 and sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 201))
    first = {r["doc_id"] for r in out if r["rank"]}
    assert len(first) == 1  # both ids' rows tie among themselves, one id scores higher


def test_a_tournament_gives_the_least_head():
    rng, tree, open_ = random.Random(1), resampling.Tournament(), {}
    for _ in range(2000):
        if open_ and rng.random() < 0.48:
            leaf = tree.winner()
            assert tree.keys[leaf] == min(open_.values())
            if rng.random() < 0.5:
                open_[leaf] = (open_[leaf][0] + rng.randint(0, 5), False, rng.randint(0, 9), len(open_))
                tree.put(leaf, open_[leaf])
            else:
                tree.close(leaf)
                del open_[leaf]
        else:
            key = (rng.randint(0, 50), False, rng.randint(0, 9), rng.randint(0, 1 << 40))
            open_[tree.open(key)] = key
    assert len(open_) > 8


# ---- 12: quality rules


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics_are_those_of_plain_python(spark, odd, small):  # noqa: F811
    extra = docs(spark, ["a b c a b c", "a b c a b c a b", "x\ny\nx\n \n \nx ", "a a a a", "a a a", "é # $ ü|<>\n\x0bé # $\x0c", "Aa aA Aa aA Aa"], 10_000)
    for rows in (odd, small, extra):
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, *tuple(r)[1:6]) for r in quality_rules.judge(rows).collect())
        assert got == sorted((d is None, d or 0, *statistics(t)) for d, t in texts_of(rows))


def judged(rows, share=0.5):
    """doc_id: kept, by exact concentration steps with a sort, from the same two starts, in numpy. rows: (doc_id, lang, source, text)."""
    limit, groups, out, d = 50.69219361081191, {}, {}, quality_rules.D
    for doc, lang, source, text in rows:
        n, chars, symbols, dup, repeats = statistics(text)
        out[doc] = not (n < 50 or 100 * repeats > 50 * n)
        if out[doc]:
            x = [math.log(n), math.log((chars + 1) / n), math.sqrt(symbols / n), repeats / (n + 20), dup / (n / 20 + 5)]
            groups.setdefault((lang or "", source or ""), []).append((doc, x))
    pooled = {}
    for (lang, source), own in groups.items():
        pooled.setdefault((lang, source if len(own) >= quality_rules.LEAST_ROWS else None), []).extend(own)
    rest = [k for k, own in pooled.items() if k[1] is None and len(own) < quality_rules.LEAST_ROWS]
    pooled[None, None] = [x for k in rest for x in pooled.pop(k)]
    floor = np.diag(np.square(quality_rules.LEAST_SPREAD))
    for own in pooled.values():
        if len(own) < quality_rules.LEAST_ROWS:
            continue
        x = np.array([v for _, v in own])
        steps = np.floor(x * 256)
        at = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
        centre = at(steps) / 256
        spread = np.sqrt((1.4826 * at(np.floor(np.abs(x - centre) * 256)) / 256) ** 2 + np.diag(floor))
        z = np.tanh((x - centre) / spread)
        c = z.T @ z
        best = None
        for share_of in (np.eye(d), c / np.sqrt(np.outer(np.diag(c), np.diag(c)) + 1e-300)):
            np.fill_diagonal(share_of, 1)
            m, cov = centre, share_of * np.outer(spread, spread) + floor
            for _ in range(30):
                off = x - m
                order = np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))[: math.ceil(len(x) * share)]
                m = x[order].mean(0)
                cov = np.cov(x[order].T, bias=True) * quality_rules.consistency(share) + floor
            if best is None or np.linalg.slogdet(cov)[1] < best[0]:
                best = np.linalg.slogdet(cov)[1], m, cov
        _, m, cov = best
        off = x - m
        near = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off) <= quality_rules.chi2_quantile(0.025, d)
        m, cov = x[near].mean(0), np.cov(x[near].T, bias=True) * quality_rules.consistency(0.975) + floor
        off = x - m
        for (doc, _), far in zip(own, np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off), strict=True):
            out[doc] = bool(far <= limit)
            DISTANCES[doc] = far
    return out


DISTANCES: dict = {}


def test_verdicts_are_those_of_exact_steps(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang <> 'fr'").withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.lit("hot")).otherwise(F.col("source")))
    got = {r["doc_id"]: r for r in quality_rules.judge(rows).collect()}
    want = judged([(r["doc_id"], r["lang"], r["source"], r["text"]) for r in rows.collect()])
    assert {d: r["kept"] for d, r in got.items()} == want
    assert any(want.values()) and not all(want.values())
    # the quantised last step and the step at which the iteration ends leave the distances near those of exact steps
    ratio = [got[d]["distance"] / far for d, far in DISTANCES.items() if far > 1]
    assert 0.7 < min(ratio) and max(ratio) < 1.4


def test_clean_documents_stay_and_junk_goes(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality_rules.judge(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").where("NOT base_failed").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in rows)


def test_quality_rules_on_odd_rows(spark, odd, empty):  # noqa: F811
    out = quality_rules.judge(odd)
    assert out.count() == odd.count()
    assert not [r for r in out.collect() if r["kept"] and r["base_failed"]]
    assert quality_rules.judge(empty).count() == 0
    few = docs(spark, [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(5)])
    assert all(r["kept"] and r["distance"] is None for r in quality_rules.judge(few).collect())
    same = docs(spark, [" ".join(f"w{j}" for j in range(60))] * 80)  # no spread at all
    assert all(r["kept"] for r in quality_rules.judge(same.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})).collect())


def test_chi_square_quantiles():
    # tabulated values
    assert abs(quality_rules.chi2_quantile(0.5, 5) - 4.35146) < 1e-4 and abs(quality_rules.chi2_quantile(0.025, 5) - 12.8325) < 1e-4
    assert abs(quality_rules.chi2_quantile(0.05, 7) - 14.0671) < 1e-4 and abs(quality_rules.chi2_quantile(0.001, 3) - 16.2662) < 1e-4


# ---- 13: source audit


def audited(rows, least=3, most=200):
    """rows: (lang, source, text)."""
    terms = lambda t: [lowered(w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    rows = [(lang or "", source or "", terms(t)) for lang, source, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        among = Counter(w for _, _, t in own for w in set(t))
        kept = [w for w, n in among.items() if n >= least]
        count = {s: Counter(w for _, x, t in own if x == s for w in t) for s in {r[1] for r in own}}
        whole = Counter(w for _, _, t in own for w in t)

        def shares(c, kept=kept):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept}

        q, p = shares(whole), {s: shares(c) for s, c in count.items()}
        for s in count:
            pairs = [(-sum((p[s][w] - p[x][w]) ** 2 // p[x][w] for w in kept), x) for x in count if x != s]
            ahead = [(-((p[s][w] - q[w]) ** 2 // q[w]), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, rows_ in (("pair", sorted(pairs, key=lambda r: (r[0], r[1].encode()))), ("term", sorted(ahead, key=lambda r: (r[0], r[1].encode()))[:most])):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(rows_, 1)]
    return sorted(out)


@pytest.mark.parametrize(("terms", "most"), [(2048, 200), (16, 7)])
def test_audit_is_that_of_plain_python(spark, small, monkeypatch, terms, most):  # noqa: F811
    monkeypatch.setattr(divergence, "BLOCK_TERMS", terms)
    monkeypatch.setattr(divergence, "TERMS_PER_GROUP", 1)
    monkeypatch.setattr(divergence, "HEAPS", 3)
    monkeypatch.setattr(divergence, "BROADCAST_CELLS", 1 << 20 if terms > 100 else 50)
    rows = small.unionByName(docs(spark, ["", None, "123 456", "only here, twice: Here"], 9000).withColumn("source", F.concat(F.lit("é"), F.col("doc_id").cast("string"))))
    got = sorted(map(tuple, divergence.audit_sources(rows, most_terms=most).collect()))
    assert got == audited([(r["lang"], r["source"], r["text"]) for r in rows.collect()], most=most)


def test_audit_on_odd_rows(spark, odd, empty):  # noqa: F811
    rows = odd.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, F.lit("en")), "source": F.when(F.col("doc_id") % 3 > 0, F.col("doc_id").cast("string"))})
    got = sorted(map(tuple, divergence.audit_sources(rows, least_documents=2).collect()))
    assert got == audited([(r["lang"], r["source"], r["text"]) for r in rows.collect()], least=2)
    assert divergence.audit_sources(empty).count() == 0


def test_a_hot_language_is_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 32)
    monkeypatch.setattr(divergence, "TERMS_PER_GROUP", 1)
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    rows = docs(spark, [" ".join("w" + name(j) for j in range(1000)) for _ in range(4)]).withColumn("source", F.col("doc_id").cast("string"))
    out = divergence.audit_sources(rows)
    assert out.where("part = 'pair' AND value = 0").count() == 12 and out.where("part = 'term'").count() == 0


def test_shares_are_exact_beyond_doubles():
    rng = random.Random(2)
    for _ in range(300):
        total, kept = rng.randint(0, 9 * 10**15 // 2), rng.randint(1, 10**9)
        count = rng.randint(0, total)
        assert divergence.shares(np.array([count]), np.int64(total), kept)[0] == 1 + 10**9 * (count + 1) // (total + kept)


def test_words_are_cut_at_texts():
    import pyarrow as pa

    codes, words, first = word_codes(pa.array(["ab", "cd éA", None, "", "ab9AB"]), LETTERS, lower=True)
    assert [words[c].as_py() for c in codes] == ["ab", "cd", "éa", "ab", "ab"] and first.tolist() == [0, 1, 3, 3, 3, 5]
    assert list(itertools.chain(word_codes(pa.array([], pa.string()), LETTERS, lower=True)[2])) == [0]
