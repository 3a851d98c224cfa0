"""The operators as registered queries, with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cnn, divergence, embeddings, html_text, huffman, jaccard, mixing, packing, quality_rules, repair, sharding, tokens, toxicity
from .common import table


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("row_", "copies")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cnn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_embedding_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_audit(table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hilbert_sharding, op2_mixing, op3_quality_rules, op4_packing, op5_quality_cnn, op6_toxicity_trees, op7_embedding_pigeonhole, op8_token_counts, op9_jaccard_join, op10_html_extraction, op11_huffman_ids, op12_conversation_repair, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the others are held against brute force in tests/llm."""
    return {
        "op1_hilbert_sharding": sharding.oracle_sql(),
        "op2_mixing": mixing.oracle_sql(),
        "op3_quality_rules": quality_rules.oracle_sql(),
        "op7_embedding_pigeonhole": embeddings.oracle_sql(),
        "op9_jaccard_join": jaccard.oracle_sql(),
        "op12_conversation_repair": repair.oracle_sql(),
        "op13_source_divergence": divergence.oracle_sql(),
    }
