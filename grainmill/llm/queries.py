"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, filter_audit, html_extract, license_scan, mixing, pii, prefix_bpe, quality, simhash, token_count, token_files, toxicity
from .sql import SQL


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, folder, "documents"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.pii_spans(_read(spark, folder, "documents")))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(_read(spark, folder, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.main_text(_read(spark, folder, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.digest(license_scan.licenses(_read(spark, folder, "documents")))


def op6_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.token_counts(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(_read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_read(spark, folder, "documents"))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _read(spark, folder, "documents"), _read(spark, folder, "labels")
    held_out = lambda column: F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 4 == 2
    model = toxicity.learn(docs, labels.where(~held_out("doc_id")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op11_prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return prefix_bpe.digest(prefix_bpe.decode(prefix_bpe.encode(_read(spark, folder, "documents"), ranks, public_tokenizers.PATTERN), ranks))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_read(spark, folder, "documents"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def queries() -> dict:
    found = (op1_simhash, op2_pii, op3_quality, op4_html, op5_licenses, op6_tokens, op7_token_files, op8_mixing, op9_decontaminate, op10_toxicity, op11_prefix_bpe, op12_collocations, op13_filter_audit)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
