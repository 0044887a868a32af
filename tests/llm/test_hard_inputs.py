"""Inputs that once exhausted memory, took time in the square of their length, or wasted room."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

import public_tokenizers
from barloom.llm import decontamination, packing, pii
from tests.llm import brute
from tests.llm.test_operators import docs


def test_many_long_benchmark_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_SEEDS", 100_000)
    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000))) for i in range(40)]
    texts = [f"lead in {' '.join(items[7 * i][1].split()[100:700])} and on" for i in range(5)] + [" ".join(f"v{rng.randrange(10**6)}" for _ in range(2000))]
    got = {(r["doc_id"], r["item_id"], r["matched"], r["position"]) for r in decontamination.leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, 7 * i, 600, -98) for i in range(5)}


def test_runs_are_verified_once_and_none_is_missed(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]  # few words, so hits stand everywhere
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(9, 40)))) for i in range(12)]
    texts = [" ".join([*(rng.choice(words) for _ in range(rng.randint(0, 300))), *items[k % 12][1].split()[: rng.randint(5, 40)], *(rng.choice(words) for _ in range(30))]) for k in range(40)]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute.leaks(list(enumerate(texts)), items) | brute.leaks_by_share(list(enumerate(texts)), items)


def test_time_is_linear_in_the_number_of_secrets(spark):
    took = {}
    for n in (2_000, 8_000, 32_000):  # the first warms up
        text = " ".join(f'token = "{i * 7919:08x}abcdef0123456789{i}"' for i in range(n))
        began = time.perf_counter()
        out = pii.digests(pii.detect(docs(spark, [text]))).first()
        took[n] = time.perf_counter() - began
        assert out["n_secret"] > n // 2  # base spans that chance to lie over a secret go before it
    assert took[32_000] < 4 * took[8_000] + 5


@pytest.mark.parametrize("kind", list(pii.CANDIDATES))
def test_context_is_what_stands_before(spark, kind):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    bits = ["a1b2c3d4e5f6g", "123456789012", "1 2 3 4 5 6 7 8 9", " ", "é🎉", "key=", '"', "\n", "x" * 30, ","]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    found = docs(spark, texts).select("text", pii.matches(F.col("text"), pii.CANDIDATES[kind], pii.NEEDED[kind], pii.CONTEXT_CHARS).alias("m")).collect()
    assert sum(len(r["m"]) for r in found) > 50
    for r in found:
        for m in r["m"]:
            assert r["text"][m["start"] : m["end"]] == m["m"] and m["before"] == r["text"][max(0, m["start"] - pii.CONTEXT_CHARS) : m["start"]]


def test_sequences_are_as_few_as_tokens_fill(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = packing.pack_documents(rows, public_tokenizers.path("word_bpe_49k.json")).select("length", "sequence_id").collect()
    assert len({r["sequence_id"] for r in out}) == -(-sum(r["length"] for r in out) // 2048)


def test_without_early_bins_one_is_begun_only_when_none_fits():
    rng = random.Random(6)
    lengths = [rng.randint(1, 20) for _ in range(300)]
    where, offset = packing.sum_of_squares(np.array(lengths), 20, early=False)
    gaps: dict[int, int] = {}
    for x, b, o in zip(lengths, where.tolist(), offset.tolist(), strict=True):
        assert o == 20 - gaps.get(b, 20)
        if b not in gaps:
            assert all(g < x for g in gaps.values())
        gaps[b] = gaps.get(b, 20) - x
    assert min(gaps.values()) >= 0
