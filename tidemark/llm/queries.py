"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, brown_lm, decontam, jaccard_join, licenses, line_dedup, secret_scan, sharding, topk, toxicity
from tidemark.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
SHARD_BYTES = 1 << 20


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in secret_scan.KINDS),
        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["base"])
    starts = F.transform(base, lambda h: h["start"].cast("long"))
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("score"),
    )


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_texts(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.find_repeats(table(spark, sf_dir, "documents"))
    span = lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"), r["first_id"].cast("string"))
    return out.select("doc_id", "n_units", F.size("removed").alias("n_removed"), F.array_join(F.transform("removed", span), ",").alias("removed"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_sharding, op3_toxicity, op4_secret_scan, op5_license_scan, op6_brown_lm, op7_jaccard_join, op8_line_dedup, op9_decontamination, op10_topk)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_sharding": sharding.sharding_sql(SHARD_BYTES),
        "op5_license_scan": licenses.scan_sql(),
        "op9_decontamination": decontam.contaminated_sql(),
        "op10_topk": topk.top_k_sql(),
    }
