"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and its decisions take
effect; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontamination, jaccard_join, packing, pii, quality
from barloom.llm.common import table

#: Documents whose quality score is below this go.
LEAST_QUALITY = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier accepts; it is fitted on labelled documents of the stage's input.

    Null and empty texts are scored as any other; rows that repeat are judged each; an empty table stays empty.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")), LEAST_QUALITY)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies.

    Texts without words all stay, null ones included; of equal rows one stays; an empty table stays empty.
    """
    return jaccard_join.without_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts stay; a row goes by its own text, whatever its id; an empty table stays empty.
    """
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and n_chars of the new text.

    Null texts stay null; rows that repeat stay each; an empty table stays empty.
    """
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens, with the ids of every piece.

    Null and empty texts are their end token; rows that repeat are packed each; an empty table gives no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # fitted models decide; tests hold each stage against plain Python instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's output is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(spark, docs, name)
    return docs


def written(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared checkpoint folder, and read from there."""
    from uuid import uuid4

    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    where = where or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{where}/pipeline-{uuid4().hex}/{name}"
    docs.write.parquet(path)
    return spark.read.parquet(path)
