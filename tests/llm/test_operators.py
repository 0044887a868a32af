"""Training-data operators against plain Python, and on empty, null, repeated and odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from barloom.llm import chat, decontamination, fingerprints, jaccard_join, packing, pii, quality, queries, sharding, token_counts, toxicity
from barloom.llm.common import Scratch
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)], KIND)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a very long one, ties, repeated rows, a null id, and columns whose names clash with the operators' own."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeéß🎉") for _ in range(rng.randint(1, 8)))
    long = " ".join(word() for _ in range(30_000))
    texts = [None, "", "   ", "one", "one two three four", "A b C d E f", "a B c D e F", long, "x" * 50_000, "1" * 20_000, "x@y.zz 1.2.3.4 +1 (017) 555-7713 4111 1111 1111 1111", "tok\x1cen <|endoftext|> </s>[INST]"]
    rows = docs(spark, texts + texts[3:6]).unionByName(docs(spark, ["one"], 3)).unionByName(docs(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("long")))
    return rows.withColumns({c: F.lit(1) for c in ("size", "grp", "run", "score", "label", "words", "token", "n", "piece", "rep", "leaking_")})


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, ["x"]).where("false")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# ---- 1: fingerprints


def test_fingerprint_edits_follow_the_order(spark, odd):
    rows = sorted(texts_of(odd), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in fingerprints.fingerprint_edits(odd).collect())
    want = []
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t) // 3
        want.append((d is None, d or 0, len(t), hashlib.sha256((t[: len(t) - n] + u[:n]).encode()).hexdigest()))
    assert got == sorted(want)


def test_fingerprints_are_context_free_and_equal_for_equal_texts(spark, small):
    text = texts_of(small)[0][1]
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), "<u4")
    _, at, h = fingerprints.syncmers(codes(text), np.array([len(text)]))
    _, bt, g = fingerprints.syncmers(codes("zz9" + text), np.array([len(text) + 3]))
    assert set(zip((at + 3).tolist(), h.tolist(), strict=True)) <= set(zip(bt.tolist(), g.tolist(), strict=True))
    # the definition, window by window
    hashes = {}
    for i in range(len(text) - fingerprints.K + 1):
        one = fingerprints.syncmers(codes(text[i : i + fingerprints.K]), np.array([fingerprints.K]))
        if len(one[0]):
            hashes[i] = int(one[2][0])
    assert hashes == dict(zip(at.tolist(), h.tolist(), strict=True))
    rows = fingerprints.fingerprint(docs(spark, [text, "other words altogether here", text])).orderBy("doc_id").collect()
    assert rows[0]["fingerprint"] == rows[2]["fingerprint"] != rows[1]["fingerprint"]


def test_likeness_tells_edited_from_other_texts(spark, small):
    rows = fingerprints.fingerprint_edits(small.where("n_chars > 300")).collect()
    assert np.mean([r["near_edited"] for r in rows]) > 0.35 and np.mean([r["near_next"] for r in rows]) < 0.1


def test_short_texts_are_alike_only_if_equal():
    rng = random.Random(3)
    for n in range(1, 31):
        texts = list({"".join(rng.choice("etaoin shr") for _ in range(n)) for _ in range(60)})
        texts += [] if n > 26 else sorted({t[:-1] + "Z" for t in texts[:20]})
        own = fingerprints.sketches(texts)
        assert all(map(len, own)) and len({fingerprints.to_text(x) for x in own}) == len(texts)
        assert [x.tolist() for x in own] == [fingerprints.sketches([t])[0].tolist() for t in texts]
        assert fingerprints.likeness(*fingerprints.sketches([texts[0]] * 2)) == 1
        if 12 <= n <= 26:
            assert all(0 < fingerprints.likeness(*fingerprints.sketches([t, fingerprints.edited(t, "Z" * n)])) < 1 for t in texts)
    assert [len(x) for x in fingerprints.sketches(["", "a"])] == [0, 1]


def test_anchors(spark, odd):
    assert fingerprints.anchors(odd.where("doc_id = 3 AND text = 'one'")).count() == 2


# ---- 2 and 9: classifiers


def test_quality_gradients():
    m, r = quality.AttentionModel(1), np.random.default_rng(0)
    x, number, y = r.normal(size=(7, quality.FEATURES)), np.array([3, 4]), np.array([0.0, 1.0])
    m.c = r.normal(size=quality.HIDDEN)

    def loss():
        p = m.forward(x, number)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in m.gradients(x, number, y).items():
        own, at = getattr(m, name), tuple(0 for _ in getattr(m, name).shape)
        own[at] += 1e-5
        high = loss()
        own[at] -= 2e-5
        assert abs((high - loss()) / 2e-5 - g[at]) < 1e-6
        own[at] += 1e-5


@pytest.mark.parametrize(("name", "label", "module"), [("op2_attention_quality", "quality", quality), ("op9_crf_toxicity", "toxic", toxicity)])
def test_held_out_accuracy(spark, name, label, module):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES[name](spark, folder).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in judged]) >= 0.95


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for few in (labels, labels.where("false")):
            out = module.score(odd, module.fit(odd, few)).collect()
            assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
        assert module.score(empty, module.fit(empty, labels)).count() == 0
    assert quality.accepted(odd, quality.AttentionModel(), 0.0).count() == odd.count()


def test_marginals_are_those_of_all_paths():
    r = np.random.default_rng(2)
    scores, lengths, t = r.normal(size=9), np.array([4, 0, 5]), r.normal(size=(2, 2))
    got, at = toxicity.marginals(scores, lengths, t), 0
    for n in lengths:
        s = scores[at : at + n]
        total, one = 0.0, np.zeros(n)
        for path in range(1 << n if n else 0):
            y = [path >> i & 1 for i in range(n)]
            p = np.exp(sum(s[i] * y[i] for i in range(n)) + sum(t[y[i - 1], y[i]] for i in range(1, n)))
            total += p
            one += p * np.array(y)
        assert n == 0 or np.allclose(got[at : at + n], one / total)
        at += n


def test_toxic_spans_are_places_in_the_text(spark):
    texts = [f"good words here number {i} and some more" for i in range(30)] + [f"good words here you blorgface number {i} and more" for i in range(30)]
    rows = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in range(60)], "doc_id long, toxic int")
    for r in toxicity.score(rows, toxicity.fit(rows, labels)).where("doc_id >= 30").collect():
        assert any("blorgface" in texts[r["doc_id"]][int(a) : int(b)] for a, b in (s.split(":") for s in r["spans"].split(",")))


# ---- 3: shards


def best_capacity(sizes, shards):
    low = max(sizes, default=0)
    while True:
        used, held = 1, 0
        for s in sizes:
            if held + s > low:
                used, held = used + 1, 0
            held += s
        if used <= shards:
            return low
        low += 1


def test_capacity_is_the_smallest():
    rng = random.Random(3)
    for _ in range(200):
        sizes, shards = [rng.randint(1, 20) for _ in range(rng.randint(1, 25))], rng.randint(1, 6)
        capacity = sharding.smallest_capacity(sizes, shards)
        assert capacity == best_capacity(sizes, shards)
        cut = sharding.near_equal_cuts(sizes, shards, capacity)
        assert cut == sorted(cut) and max(sum(s for s, c in zip(sizes, cut, strict=True) if c == k) for k in range(shards)) <= capacity


def test_shards(spark, odd, empty, small):
    for rows in (odd, small):
        out = sharding.shard_documents(rows, 8).collect()
        assert len(out) == rows.count()
        by, shard_of = {}, {}
        for r in out:
            by.setdefault(r["shard"], []).append(r["slot"])
            shard_of.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(8))
        assert all(len(s) == 1 for s in shard_of.values())
        number = lambda d: -1 if d is None else d
        assert sorted((number(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted((number(d), len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts_of(rows))
    assert sharding.shard_documents(empty, 8).count() == 0


# ---- 4: chat


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "[", "[/INST", "<\\s>", "", None, "a\\", "🎉[/INST]\n", "<s><s>[\\INST]"]
    rows = [(c, t, role, hard[(c + t) % len(hard)]) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "user", "assistant", None, "a\nb\\"])]
    rows += [(3, 0, "system", hard[3]), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit("x"), "n_turns": F.lit(0)}).repartition(3)
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(table)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(x[2], x[4]) for x in sorted(turns)]
        learnt = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.format_conversations(table.where("false")).count() == 0


def test_no_control_string_stands_in_a_text(spark):
    table = spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]<s>")], "conv_id long, turn long, role string, text string")
    whole = chat.format_conversations(table).first()["formatted"]
    assert [whole.count(x) for x in (chat.BEGIN, chat.END, chat.TURN, chat.CLOSE)] == [1, 1, 1, 1]


def test_a_conversation_may_span_batches():
    batch = lambda ids: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(["user"] * len(ids)), pa.array(["t"] * len(ids))], ["conv_id", "role", "text"])
    out = [r for b in chat._format(iter([batch([1, 1]), batch([1]), batch([1, 2]), batch([2, 3]), batch([4])])) for r in b.to_pylist()]
    assert [(r["conv_id"], r["n_turns"]) for r in out] == [(1, 4), (2, 2), (3, 1), (4, 1)]


# ---- 5: decontamination


def test_leaks_are_those_of_brute_force(spark, small):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(small, bench).collect()}
    assert got == brute.leaks(texts_of(small), [(r["item_id"], r["text"]) for r in bench.collect()])
    assert got


def test_substitutions_are_tolerated_and_odd_rows_pass(spark, odd, empty):
    item = [f"w{i}" for i in range(40)]
    changed = [("zz" if i % 9 == 4 else w) for i, w in enumerate(item)]
    rows = docs(spark, ["lead in " + " ".join(changed).upper() + ", end", " ".join(item[:8]), " ".join(reversed(item))])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (1, " ".join(item))], "item_id long, text string")
    out = decontamination.leaks(rows, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["matched"], r["position"]) for r in out] == [(0, 1, 36, 2)] or out[0]["doc_id"] == 0
    assert {r["doc_id"] for r in out} == {0}
    assert {r["doc_id"] for r in decontamination.without_leaks(rows, bench).collect()} == {1, 2}
    assert decontamination.without_leaks(odd, bench).count() == odd.count()
    assert decontamination.leaks(empty, bench).count() == decontamination.leaks(odd, bench.where("false")).count() == 0


def test_four_words_in_five_leak_wherever_the_others_stand(spark):
    rng = random.Random(5)
    items, texts = [], []
    for n in (15, 16, 18, 23, 40):
        item = [f"w{n}x{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        ways = list(itertools.combinations(range(n), n // 5)) if n == 15 else [rng.sample(range(n), k) for k in (n // 5, n // 5 + 1) for _ in range(40)]
        texts += ["lead in " + " ".join("zz" if j in way else w for j, w in enumerate(item)) + " and on" for way in ways]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    rows = list(enumerate(texts))
    assert got == brute.leaks_by_share(rows, items) | brute.leaks(rows, items)
    assert len(got) >= 455 + 4 * 40


def test_short_items_leak_anywhere_in_a_text(spark):
    items, texts = [], ["w9x0 w9x1 other words"]
    for n in range(1, 15):
        item = [f"w{n}x{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        texts += ["lead in " + " ".join("zz" if j in way else w for j, w in enumerate(item)) + " and on" for k in (0, n // 5, n // 5 + 1) for way in itertools.combinations(range(n), k)]
    texts = sorted(set(texts))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    rows = list(enumerate(texts))
    assert got == brute.leaks_by_share(rows, items) | brute.leaks(rows, items)
    assert {i for _, i in got} == set(range(1, 15))


# ---- 6: token counts


def test_token_counts_are_the_tokenizers(spark, odd, empty, small):
    from tokenizers import Tokenizer, models, pre_tokenizers

    whole = Tokenizer(models.Unigram(token_counts.piece_vocabulary(PIECES), 0, True))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    count = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    extra = docs(spark, ["  a  b", "日本語 テキスト <s> </s> ▁x", "zzzz🎉🎉 q", " ", "<0x0A>"])
    for rows in (small.limit(60), odd.where("length(text) < 1000 OR text IS NULL").select("doc_id", "text"), extra):
        want = sorted((d is None, d or 0, count(t)) for d, t in texts_of(rows))
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.count_tokens(rows, PIECES).collect()) == want
    assert token_counts.count_tokens(odd, PIECES).count() == odd.count() and token_counts.count_tokens(empty, PIECES).count() == 0


def test_ties_keep_the_longest_last_piece():
    counter = token_counts.UnigramCounter([("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -1.0), ("bc", -1.0)])
    assert counter.count("abc") == 2


# ---- 7: personal data


def test_base_spans_are_those_of_the_patterns(spark, odd, empty):
    rng = random.Random(5)
    texts = ["".join(rng.choice("0123456789....@@+-_ ()abZ%é🎉\n,") for _ in range(rng.randint(1, 100))) for _ in range(150)]
    texts += ["4111 1111-1111 1111 x 🎉 4111111111111111,+1 (017) 555-7713 1.2.3.4.5.6.7.8 a@b.c_d@e.f a@b.c@d.e 001.2.3.4 " + "9" * 30 + ".1.1.1", "1" * 8000, "1." * 900, "a." * 900 + "@" + "b." * 900]
    rows = docs(spark, texts).unionByName(odd.where("length(text) < 25000 OR text IS NULL").select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 1000))
    known = dict(texts_of(rows.where("doc_id IS NOT NULL")))
    for r in pii.digests(pii.detect(rows)).where("doc_id IS NOT NULL").collect():
        found = brute.base_spans(known[r["doc_id"]])
        line = ",".join(f"{k}:{a}:{b}" for k, s in found.items() for a, b in s)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and r["spans"].startswith(line), known[r["doc_id"]][:200]
        assert all(r[f"n_{k}"] == len(s) for k, s in found.items())
    assert pii.detect(empty).count() == 0


def test_prefix_sums_over_blocks(spark):
    values = [(i * 7) % 11 for i in range(1000)]
    got = spark.createDataFrame([(values,), ([],)], "v array<bigint>").select(pii.prefix_sums(F.col("v")).alias("s")).collect()
    assert got[0]["s"] == np.cumsum(values).tolist() and got[1]["s"] == []


def test_secrets_are_added_and_redaction_keeps_columns(spark, odd):
    rows = docs(spark, [f'plain words {i} token = "269b1cea0846965f2d3ecb5aa{i:04d}" end a{i}@b.cc.' for i in range(40)] + ["nothing here", None])
    out = {r["doc_id"]: r for r in pii.redact(rows).collect()}
    assert out[3]["text"] == 'plain words 3 token = "[SECRET]" end [EMAIL].' or "[EMAIL]" in out[3]["text"]
    assert "269b1c" not in out[3]["text"] and out[40]["text"] == "nothing here" and out[41]["text"] is None
    assert all(r["n_chars"] == len(r["text"]) for r in out.values() if r["text"] is not None)
    done = pii.redact(odd)
    assert done.columns == odd.columns and done.count() == odd.count()


def test_reliabilities_favour_labelers_that_agree():
    patterns = [((1, 1, 1, 1, -1), 40.0), ((-1, -1, -1, -1, 1), 40.0), ((1, 1, 1, 1, 1), 5.0), ((-1, -1, -1, -1, -1), 5.0)]
    prior, chance = pii.estimate(patterns)
    assert abs(prior - 0.5) < 0.05 and chance[0][1][0] > 0.9 and chance[4][1][0] < 0.3


# ---- 8: packing


def test_pieces_hold_the_tokenizers_ids(spark, odd, empty, small):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    extra = docs(spark, ["a<|endoftext|>b", "Straße 'S don't WE'LL É é İ x\x1cy K ９９ a.b!c??!.", "\n\n  x ", "<|ENDOFTEXT|>"], 5000)
    for rows in (small.limit(40).select("doc_id", "text"), odd.select("doc_id", "text"), extra.select("doc_id", "text")):
        got: dict = {}
        out = packing.pack_documents(rows, BPE, with_ids=True).collect()
        for r in out:
            assert r["length"] == len(r["ids"]) <= 2048 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
        for d, t in texts_of(rows):
            want = [*whole.encode(t, add_special_tokens=False).ids, 0]
            if sum(1 for e, _ in texts_of(rows) if e == d) == 1:
                assert [i for _, _, ids in sorted(got[d]) for i in ids] == want
        sequences: dict = {}
        for r in out:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
    assert packing.pack_documents(empty, BPE).count() == 0


def test_sum_of_squares_is_the_rule():
    rng, size = random.Random(4), 20
    lengths = [rng.randint(1, 20) for _ in range(200)]
    where, offset = packing.sum_of_squares(np.array(lengths), size)
    gaps: dict[int, int] = {}
    for x, b in zip(lengths, where.tolist(), strict=True):
        counts: dict[int, int] = {}
        for g in gaps.values():
            counts[g] = counts.get(g, 0) + 1

        def squares(gap: int, x=x, counts=counts) -> int:
            after = dict(counts)
            if gap < size:
                after[gap] -= 1
            after[gap - x] = after.get(gap - x, 0) + 1
            return sum(n * n for g, n in after.items() if 0 < g < size)

        options = sorted((squares(g), g) for g in {*(g for g in gaps.values() if x <= g < size), size} if g >= x)
        chosen = gaps.get(b, size)
        assert squares(chosen) == options[0][0]
        gaps[b] = chosen - x


# ---- 10: Jaccard join


@pytest.mark.parametrize("often", [2, 40])
def test_classes_are_those_of_brute_force(spark, often):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    shared = [rng.choice(vocabulary) for _ in range(25)]
    texts = [None, "", " \t\n", "a", "A", "a b", "a b c d", "A B c D"]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        if rng.random() < 0.5:
            base = shared + base
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy[: len(copy) - rng.randint(0, 2)]))
    rows = docs(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(rows, often).collect()}
    assert got == brute.jaccard_classes(list(enumerate(texts)))


def test_classes_on_odd_rows(spark, odd, empty):
    out = jaccard_join.jaccard_classes(odd)
    assert out.count() == odd.count()
    kept = jaccard_join.without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("text = 'one'").count() == 1
    assert jaccard_join.jaccard_classes(empty).count() == jaccard_join.without_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("last", [1 << 20, 0])
def test_components_of_chains_and_stars(spark, last):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, j) for j in range(101, 140)] + [(7, 7)]
    with Scratch(spark) as t:
        found = jaccard_join.components(spark.createDataFrame(edges, "a long, b long").repartition(3), t, "c", last)
        roots = {r["node"]: r["root"] for r in found.collect()}
    assert len(roots) == 31 + 40
    assert all(roots[i] == 10 for i in range(10, 41)) and all(roots[i] == 100 for i in range(100, 140))


def test_a_leader_of_many_copies_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:30] + [f"x{k}"] + words[30:]) for k in range(120)] + [" ".join(reversed(words))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs(spark, texts)).collect()}
    assert got == brute.jaccard_classes(list(enumerate(texts)))


def test_rows_of_a_shared_id_go_by_their_own_text(spark):
    item = " ".join(f"word{i}" for i in range(30))
    rows = spark.createDataFrame([(None, f"before {item} after"), (None, "a clean text"), (3, item), (3, "another clean text"), (4, None)], "doc_id long, text string")
    kept = decontamination.without_leaks(rows, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(str(r["text"]) for r in kept.collect()) == ["None", "a clean text", "another clean text"]


# ---- hot, null, sparse and extreme ids


def spread(df):
    """Rows of each task that gives any."""
    return sorted(len(x) for x in df.rdd.mapPartitions(lambda rows: [list(rows)]).collect() if x)


def test_fingerprint_runs_split_sparse_and_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN_ROWS", 50)
    ids = [*range(300), 1 << 50, -(1 << 63), (1 << 63) - 1] + [77] * 300 + [None] * 300
    rows = spark.createDataFrame([(d, f"text number {k} of these") for k, d in enumerate(ids)], "doc_id long, text string")
    out = fingerprints.fingerprint_edits(rows)
    sizes = spread(out)
    assert sum(sizes) == len(ids) and max(sizes) <= 150
    # every row is followed by the next one once: the edits borrow each text's head from exactly one other row
    assert out.where("doc_id IS NULL").count() == 300 and out.where("doc_id = 77").count() == 301


def test_positions_decide_likeness():
    rng = random.Random(5)
    blocks = ["".join(rng.choice("abcdefghij ") for _ in range(400)) for _ in range(6)]
    same, inserted, turned = "".join(blocks), blocks[0] + "new words " + "".join(blocks[1:]), "".join(reversed(blocks))
    a, b, c = fingerprints.sketches([same, inserted, turned])
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, b) > 0.8 > 0.5 > fingerprints.likeness(a, c)


def test_fingerprints_and_likeness_from_their_definition():
    """Anchors found window by window in plain Python; likeness by sets and all orders."""
    rng = random.Random(6)
    for n in (40, 90, 300):
        text = "".join(rng.choice("abcdef gh") for _ in range(n))
        other = text[: n // 2] + "".join(rng.choice("abcdef gh") for _ in range(n // 2))
        sketches = fingerprints.sketches([text, other])
        plain = [brute.syncmer_sketch(t, fingerprints) for t in (text, other)]
        assert [s.tolist() for s in sketches] == plain
        assert fingerprints.likeness(*sketches) == pytest.approx(brute.positional_likeness(*plain, fingerprints.KEPT, fingerprints.PLACE_BITS))


def test_chat_keeps_large_and_null_ids_apart(spark):
    ids = [None, 1 << 53, (1 << 53) + 1, None]
    rows = spark.createDataFrame([(d, k, "user", f"t{k}") for k, d in enumerate(ids)], "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.format_conversations(rows).collect()}
    assert got == {None: 2, 1 << 53: 1, (1 << 53) + 1: 1}


def test_pieces_of_one_id_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 40)
    rows = spark.createDataFrame([(None, "a few words")] * 400, "doc_id long, text string").repartition(4)
    out = packing.pack_documents(rows, BPE)
    assert out.select(F.shiftright("sequence_id", 32).alias("g")).distinct().count() >= 8 and out.count() == 400


def test_tokenizers_of_other_kinds_are_refused():
    with pytest.raises(ValueError):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("hot", [0, 3, 9])
def test_cuts_are_contiguous_and_minimax(hot):
    rng = random.Random(hot)
    sizes = [rng.randint(1, 30) for _ in range(400)]
    for k in range(hot):
        sizes[rng.randrange(400)] = 900 + k
    shards = sharding.cut(sizes, 40)
    assert shards == sorted(shards) and set(shards) <= set(range(40))
    totals = [sum(s for s, x in zip(sizes, shards, strict=True) if x == k) for k in range(40)]
    assert max(totals) == sharding.smallest_capacity(sizes, 40) or max(totals) <= max(sizes)
    assert min(totals) > 0


def test_long_copies_are_verified_once_a_run(spark):
    words = [f"w{i}" for i in range(3000)]
    item = " ".join(words)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    hits = decontamination.leaks(docs(spark, [item, "x " * 700 + item, " ".join(w if k % 9 else "other" for k, w in enumerate(words))]), bench)
    got = {r["doc_id"]: (r["matched"], r["position"]) for r in hits.collect()}
    # of the changed copy 2666 words agree; the best stretch ends before the last change, whose cost of 3 the two words behind it do not win back
    assert got[0] == (3000, 0) and got[1] == (3000, 700) and got[2][0] == 3000 - 334 - 2 and got[2][1] == 0


def test_redaction_is_that_of_plain_python(spark):
    rng = random.Random(8)
    kinds = ["a.b@c.dd", "1.2.3.4", "4111 1111 1111 1111", "+1 (017) 555-7713", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "word", "ß🎉", "id 123-45-6789", "9870157079875996"]
    texts = [" ".join(rng.choice(kinds) for _ in range(n)) for n in (0, 1, 3, 10, 60, 400, 3000)] + [None]
    rows = docs(spark, texts)
    spans = {r["doc_id"]: r["spans"] for r in pii.digests(pii.detect(rows)).collect()}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(rows).collect()}
    for d, text in enumerate(texts):
        if text is None:
            assert got[d] == (None, None)
            continue
        out, at = [], 0
        for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans[d].split(",") if x)):
            if start >= at:
                out.append(text[at:start] + f"[{kind.upper()}]")
            at = max(at, end)
        want = "".join(out) + text[at:]
        assert got[d] == (want, len(want))


def test_added_spans_are_told_from_decoys(spark):
    """Precision and recall of added spans on made cases: announced secrets and grouped numbers against bare runs of digits."""
    rng = random.Random(9)
    hexed = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    real = [f'here token = "{hexed()}" ends' for _ in range(60)] + [f"my ssn {rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)} is" for _ in range(30)]
    decoys = [f"said, {d} and" for d in (rng.randint(10**15, 10**16 - 1) for _ in range(60))] + [f"the part {rng.choice('abc')}{rng.randint(10**11, 10**12)} lies" for _ in range(10)]
    rows = pii.digests(pii.detect(docs(spark, real + decoys))).collect()
    found = {r["doc_id"] for r in rows if r["n_number"] + r["n_secret"]}
    hits = len([d for d in found if d < len(real)])
    assert hits >= 0.9 * len(real) and hits >= 0.9 * len(found)


# ---- the pipeline


def test_pipeline_stages_against_plain_python(spark, tmp_path):
    """Each stage on what its predecessor kept, held against a plain computation on that stage's input."""
    import corpus_pipeline

    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, out = rows.columns, {}
    kept = rows
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, FOLDER).write.parquet(f"{tmp_path}/{name}")
        out[name] = (kept, spark.read.parquet(f"{tmp_path}/{name}"))
        kept = out[name][1]
        assert k == len(corpus_pipeline.STAGES) - 1 or kept.columns == columns
    before, after = out["quality_classifier"]
    model = quality.fit(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(before, model).where("score >= 0.5").collect()}
    assert {d for d, _ in texts_of(after)} == good and 0 < len(good) < before.count()
    before, after = out["ngram_jaccard_join"]
    classes = brute.jaccard_classes(texts_of(before))
    assert {d for d, _ in texts_of(after)} == {d for d, (_, c) in classes.items() if c == d}
    before, after = out["benchmark_decontamination"]
    leaking = {r["doc_id"] for r in decontamination.leaks(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert {d for d, _ in texts_of(after)} == {d for d, _ in texts_of(before)} - leaking
    before, after = out["personal_data"]
    assert before.count() == after.count() and after.where(F.col("text").rlike(r"[a-z]@[a-z]+\.[a-z]")).count() == 0
    before, after = out["best_fit_packing"]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    packed = after.collect()
    assert sum(r["length"] for r in packed) == sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts_of(before))
    filled: dict = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048
