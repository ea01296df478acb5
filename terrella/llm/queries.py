"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.llm import license_scan, secret_scan, token_counts
from terrella.llm.bpe import bpe
from terrella.llm.exact_dedup import exact_dedup
from terrella.llm.mixing import mix
from terrella.llm.near_dedup import near_dedup
from terrella.llm.quality_classifier import quality_classifier
from terrella.llm.quality_rules import quality_rules
from terrella.llm.sharding import kd_shards
from terrella.llm.store import save
from terrella.plans.written import new_folder

#: The rank file of op3; its folder must be the same on all executors.
RANKS = "byte_bpe_multi_50k.tiktoken"


#: Target shares of op2: a large source held down, two raised; all others share the rest by the square roots of their sizes.
SHARES = {"src0": 0.10, "src1": 0.12, "src2": 0.08}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.floor(F.log2(F.octet_length(F.coalesce("text", F.lit(""))) + 1) * 65_536)
    dims = {"source": F.col("source"), "lang": F.col("lang"), "length": length, "doc_id": F.col("doc_id")}
    placed = kd_shards(_documents(spark, sf_dir), dims, shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir), SHARES, rest=0.70)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(_documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "points", "host_docs", "host_failed", "host_rate")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    ratios, threshold = secret_scan.fitted(save(secret_scan.labelled_samples(docs), "samples"))
    return secret_scan.digest(secret_scan.secret_scan(docs, ratios, threshold=threshold))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(list(license_scan.TEMPLATES), "label string, text string")
    return license_scan.digest(license_scan.license_scan(_documents(spark, sf_dir), templates))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of two tokenizer versions: words and byte-level BPE. Estimates of a token for four bytes come first; documents labelled toxic are taken down."""
    rows = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", "lang", (F.octet_length(F.coalesce("text", F.lit(""))) / 4).cast("long").alias("estimate"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long").alias("words_v1"), "text")
    counts = bpe(rows, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=("id", "source", "lang", "estimate", "words_v1"), outputs=("n_tokens",))
    counts = save(counts.withColumnRenamed("n_tokens", "byte_bpe_multi_50k"), "counts")
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("id"))
    rollup = token_counts.Rollup(spark, new_folder(spark, "rollup"))
    return token_counts.token_rollup(rollup, counts, toxic, ("words_v1", "byte_bpe_multi_50k"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can express."""
    return op6_secret_scan(spark, sf_dir).drop("spans")


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7 that SQL can express."""
    return op7_license_scan(spark, sf_dir).drop("labels", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_kd_shards, op2_pfair_mix, op3_byte_bpe, op4_quality_classifier, op5_quality_rules, op6_secret_scan, op7_license_scan, op8_token_counts, op9_exact_dedup, op10_simhash, base_secrets, base_licenses)
    return {f.__name__: f for f in found}
