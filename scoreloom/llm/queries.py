"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import bpe, decontamination, divergence, embeddings, interactions, lines, minhash, pages, quality, secrets, sharding, substrings, toxicity
from scoreloom.llm.common import table


def encoded(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens and the digests of its ids and of their decoding."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(docs.select("doc_id", "text"), path, pattern).select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "class_doc", "class_line", "kept")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_embeddings": op3_embeddings,
    "op4_decontamination": op4_decontamination,
    "op5_sharding": op5_sharding,
    "op6_secrets": op6_secrets,
    "op7_lines": op7_lines,
    "op8_minhash": op8_minhash,
    "op9_substrings": op9_substrings,
    "op10_toxicity": op10_toxicity,
    "op11_quality": op11_quality,
    "op12_interactions": op12_interactions,
    "op13_divergence": op13_divergence,
}

OP3_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT r.id, p.b FROM r JOIN p ON r.c = p.a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.c AS component_id, vec_id = m.c AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.id = vec_id"""

OP4_SQL = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\\x00-\\x7F])+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\\x00-\\x7F])+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i WHERE len(w) > 0),
q AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY 1), h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN si USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM h JOIN q USING (item_id) WHERE n_shared >= n_item * 0.8::DOUBLE - 1e-9"""

ORACLE_SQL: dict[str, str] = {
    "op3_embeddings": OP3_SQL,
    "op4_decontamination": OP4_SQL,
    "op12_interactions": interactions.SQL,
    "op13_divergence": divergence.SQL,
}
