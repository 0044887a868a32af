"""Each stage of the pipeline against plain Python, and all of them on odd and empty tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import docs, empty, odd, small, texts_of  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_one_document_of_each_group_stays(spark, small):  # noqa: F811
    rows = small.unionByName(docs(spark, [None, "", "one two three", "One two three", "one  two\tthree x"], 90_000).select(*small.columns))
    kept = {r["doc_id"] for r in STAGES["ngram_jaccard_join"](spark, rows, FOLDER).collect()}
    groups: dict = {}
    for d, (size, root) in brute.jaccard_classes(texts_of(rows)).items():
        groups.setdefault(root if size else ("alone", d), set()).add(d)
    assert all(len(own & kept) == 1 for own in groups.values()) and len(kept) == len(groups) < rows.count()


def test_documents_with_benchmark_passages_go_and_no_others(spark, small):  # noqa: F811
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = texts_of(small)
    leaking = {d for d, _ in brute.leaks(rows, items) | brute.leaks_by_share(rows, items)}
    kept = {r["doc_id"] for r in STAGES["benchmark_decontamination"](spark, small, FOLDER).collect()}
    assert kept == {d for d, _ in rows} - leaking and leaking


def replaced(text: str) -> str:
    """The text with its base spans replaced by their kinds; of spans that overlap the first stands for all."""
    spans = sorted((a, b, kind) for kind, own in brute.base_spans(text).items() for a, b in own)
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_base_spans_are_replaced(spark, small):  # noqa: F811
    before, plain, tagged = dict(texts_of(small)), 0, 0
    for r in STAGES["personal_data"](spark, small, FOLDER).collect():
        text = r["text"]
        assert r["n_chars"] == len(text)
        if "[SECRET]" not in text and "[NUMBER]" not in text:
            assert text == replaced(before[r["doc_id"]])
            plain += 1
            tagged += text != before[r["doc_id"]]
        else:  # further kinds came in, base spans still went
            assert not brute.base_spans(text)["email"]
    assert plain > 100 and tagged > 5


def test_quality_keeps_what_is_labelled_good(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in STAGES["quality_classifier"](spark, rows, folder).collect()}
    right = [(d in kept) == bool(q) for d, q in labels.items()]
    assert sum(right) >= 0.97 * len(right)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_odd_and_empty_tables(spark, odd, empty, name):  # noqa: F811
    out = STAGES[name](spark, odd, FOLDER)
    n, columns = out.count(), out.columns
    if name == "best_fit_packing":
        assert n >= odd.count()
        assert STAGES[name](spark, empty, FOLDER).count() == 0
    else:
        assert 0 < n <= odd.count() and set(empty.columns) <= set(columns)
        nothing = STAGES[name](spark, empty, FOLDER)
        assert nothing.count() == 0 and nothing.columns == empty.columns
