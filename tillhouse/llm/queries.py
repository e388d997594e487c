"""The registered queries of this package, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillhouse.llm import (
    alignment, bpe, decontaminate, exact, jaccard, language, licenses, merkle, oracle, quality_rules, sharding, substrings, toxicity, warc,
)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licences(table(spark, folder, "documents"))


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(table(spark, folder, "documents")).drop("_text_key")


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digests(table(spark, folder, "documents"))


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), RANKS, PATTERN).drop("ids")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.judged(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives, index = warc.archive(table(spark, folder, "pages"))
    return warc.read_records(archives, index).drop("payload", "url")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, folder, "documents"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified(table(spark, folder, "documents"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.weighed(table(spark, folder, "documents"), BYTE_VOCABULARY, PIECE_MODEL)


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.judged(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_license_scan,
        op2_jaccard_join,
        op3_substring_dedup,
        op4_byte_bpe,
        op5_decontamination,
        op6_warc,
        op7_quality_rules,
        op8_toxicity,
        op9_sharding,
        op10_language,
        op11_merkle_manifest,
        op12_token_alignment,
        op13_exact_dedup,
    )
} | {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = oracle.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
