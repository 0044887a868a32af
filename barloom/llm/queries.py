"""The queries of the training-data operators, as `__spark_entry__` registers them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import chat, decontamination, divergence, fingerprints, jaccard_join, packing, pii, quality, quality_rules, resampling, sharding, token_counts, toxicity
from barloom.llm.common import held_out, table


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text. Null and empty texts have the empty fingerprint; rows that repeat
    an id follow each other by a hash of their text; null ids come last; an empty table gives no rows."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and a place for every row. Null texts stand with the empty ones; equal texts share a shard; rows that repeat
    have a place each; an empty table gives no rows."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from every formatted conversation and from one that quotes control strings. Null roles and texts are
    empty; a null conv_id is a conversation of its own; rows of one turn go by role and text; an empty table leaves the one."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(own)))


def op6_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text. Null and empty texts have none; rows that repeat are counted each; an empty table gives no rows."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence and an offset for every piece of every text. Null and empty texts are their end token; rows that repeat are
    packed each; a null id is kept; an empty table gives no rows."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every text, empty and null ones too, from a model fitted outside the held-out fold. Rows that repeat
    are scored each; a null id is kept; labels of no document do not count; an empty table gives no rows."""
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"))
    scored = quality.score(documents, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "attention")


def op5_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds. Null and empty texts on either side hold nothing; rows of one id
    are taken together; an empty table gives no rows."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text. Null and empty texts have none; rows that repeat are searched each; a null id is
    kept; an empty table gives no rows."""
    return pii.digests(pii.detect(table(spark, sf_dir, "documents")))


def op9_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every text and its offending spans, from a model fitted outside the held-out fold. Empty and null texts
    are scored without spans; rows that repeat are scored each; an empty table gives no rows."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_spans", "spans")


def op10_token_group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and near-copy class of every row. Null texts and texts without words link with nothing; equal rows share a
    class; rows with a null id have none; an empty table gives no rows."""
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, weight, score and rank in the draw. Null and empty texts have no words and are never drawn;
    rows that repeat an id are ranked each; an empty table gives no rows."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_robust_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics of every document, the fixed limits and the robust verdict. Null and empty texts fail the limits;
    rows that repeat are judged each; an empty table gives no rows."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language and the foremost terms of each. Null text, lang and source are '';
    rows that repeat count each; an empty table gives no rows."""
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_syncmer_fingerprints, op2_attention_quality, op3_minimax_shards, op4_chat_format, op5_spaced_seed_decontamination, op6_viterbi_token_counts,
        op7_weak_supervision_pii, op8_sum_of_squares_packing, op9_crf_toxicity, op10_token_group_jaccard,
        op11_importance_resampling, op12_robust_quality_rules, op13_source_divergence,
    )
}

#: DuckDB SQL of the queries that SQL can express whole; tests hold the others against plain Python.
ORACLE_SQL: dict[str, str] = {
    "op4_chat_format": r"""WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), chr(10), '\' || chr(10)))
+ length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) + 14 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(n) + 7 AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op10_token_group_jaccard": r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) END AS s FROM t),
n AS (SELECT doc_id, len(s) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 80 * (u.n + v.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op11_importance_resampling": r"""WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
x AS (SELECT doc_id, unnest(w) AS w FROM d), v AS (SELECT w, hex(w) AS h FROM (SELECT w FROM x UNION SELECT w FROM e)),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: (strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1)),
lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)])), 4294967295) % 10000 AS k FROM v, tab),
s AS (SELECT k, count(*) AS n FROM x JOIN b USING (w) GROUP BY k), u AS (SELECT k, count(*) AS n FROM e JOIN b USING (w) GROUP BY k),
a AS (SELECT (SELECT count(*) FROM x) AS alls, (SELECT count(*) FROM e) AS allt),
g AS (SELECT k.k, CAST(floor(1000 * ln((coalesce(u.n, 0) + 1.0::DOUBLE) * (alls + 10000) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * (allt + 10000)))) AS BIGINT) AS g FROM (SELECT DISTINCT k FROM b) k LEFT JOIN s USING (k) LEFT JOIN u USING (k), a),
m AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM x JOIN b USING (w) JOIN g USING (k) GROUP BY doc_id),
h AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: CAST(strpos('0123456789abcdef', sha256('2024:' || doc_id)[i]) - 1 AS BIGINT))), lambda c, y: c * 16 + y) AS h FROM documents),
r AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
FROM d JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN rank <= n * 10 // 100 THEN rank END AS BIGINT) AS rank FROM r LEFT JOIN o USING (doc_id)""",
    "op13_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM d),
k AS (SELECT lang, w, count(*) AS q FROM x GROUP BY lang, w HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, w, count(*) AS c FROM x JOIN k USING (lang, w) GROUP BY ALL),
l AS (SELECT d.lang, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM d) d LEFT JOIN (SELECT lang, count(*) AS v, sum(q) AS n FROM k GROUP BY lang) k USING (lang)),
g AS (SELECT d.lang, d.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) c USING (lang, source)),
p AS (SELECT g.lang, g.source, k.w, coalesce(c.c, 0) AS c, CAST(1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (g.n + l.v) AS HUGEINT) AS p, CAST(1 + 1000000000::HUGEINT * (k.q + 1) // (l.n + l.v) AS HUGEINT) AS q
FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.w = k.w),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', w, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u QUALIFY part = 'pair' OR rank <= 200""",
}
