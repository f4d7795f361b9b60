"""The thin opN_ queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, licenses, lm_score, packing, quality, secrets, simhash, token_counts, topk, toxicity
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        secrets.counted(spans, 0).alias("n_assign"),
        secrets.counted(spans, 1).alias("n_access"),
        secrets.counted(spans, 2).alias("n_hex"),
        F.sha2(secrets.spelled(base).cast("binary"), 256).alias("base_sha256"),
        secrets.spelled(spans).alias("spans"),
    )


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_codec.encode(table(spark, sf_dir, "documents"))
    encoded = encoded.withColumn("offsets_sha256", F.sha2(F.concat(*bpe_codec.OFFSETS), 256)).drop(*bpe_codec.OFFSETS)  # digested before they would travel on
    return bpe_codec.decode(encoded).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
        "offsets_sha256",
        F.char_length("text").cast("long").alias("n_chars"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_simhash": op1_simhash, "op4_lm_score": op4_lm_score, "op2_toxicity": op2_toxicity, "op3_token_counts": op3_token_counts, "op5_quality_rules": op5_quality_rules, "op6_license_scan": op6_license_scan, "op7_secret_scan": op7_secret_scan, "op8_topk": op8_topk, "op9_packing": op9_packing, "op10_bpe_codec": op10_bpe_codec}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality.oracle_sql(), "op6_license_scan": licenses.oracle_sql(), "op8_topk": topk.ORACLE_SQL}
