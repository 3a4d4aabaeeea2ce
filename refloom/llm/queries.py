"""The registered queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm import bpe_tree, embedding_dedup, exact_dedup, jaccard_join, packing, quality, repeated_phrases, resharding, token_counts, warc
from refloom.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.round_trip(table(spark, sf_dir, "pages")))
    return out.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_digest")).alias("text_sha256"))


def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_tree.encode_decode(table(spark, sf_dir, "documents"), WORD_BPE)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.concatenate_and_cut(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_flow_resharding(spark: SparkSession, sf_dir: str, old_shards: int = 18, shards: int = 24) -> DataFrame:
    out = resharding.initial_and_new(table(spark, sf_dir, "documents"), old_shards, shards)
    return out.select("doc_id", "size", F.crc32(F.encode("content", "utf-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_phrases.remove_repeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_warc_segments, op2_exact_dedup, op3_bpe_tree, op4_packing, op5_embedding_dedup, op6_jaccard_join, op7_quality, op8_token_counts, op9_flow_resharding, op10_repeated_phrases)}
