"""A training corpus from raw documents, in five stages over the table ``documents``.

Quality rules reject documents, the Jaccard join leaves one document of each class of
similar ones, substring dedup takes repeated passages out of the texts, decontamination
drops documents that hold benchmark passages, and byte-level BPE turns the rest into ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillhouse.llm import bpe, decontaminate, jaccard, quality_rules, substrings
from tillhouse.llm.common import ROW, stored
from tillhouse.sources.tables import recorded, release

# Scratch tables of the stage that ran last; its result is written when the next one starts.
_scratch: list[str] = []


def _stage(name, function):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, *_scratch)
        _scratch.clear()
        with recorded() as folders:
            out = function(spark, docs, sf_dir)
        _scratch.extend(folders)
        return out

    return name, run


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; see :func:`quality_rules.judged`."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class; see :func:`jaccard.distinct`."""
    return jaccard.distinct(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of earlier documents; see :func:`substrings.removed`.

    A text that loses words becomes its other words joined by one space, one that loses none
    stays as it is. A document that loses all its words goes. A column ``n_chars`` follows
    the text.
    """
    whole, cut = substrings.shortened(docs)
    cut = cut.filter(F.col("n_removed") < F.col("n_words"))
    columns = []
    for field in docs.schema:
        value = F.col(ROW)[field.name]
        if field.name == "text":
            value = F.col("kept")
        elif field.name == "n_chars":
            value = F.length("kept").cast(field.dataType)
        columns.append(value.alias(field.name))
    return whole.unionByName(cut.select(*columns))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; see :func:`decontaminate.judged`."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and digests of them and of what they decode to; see :func:`bpe.digests`."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    _stage("quality_rules", quality),
    _stage("jaccard_join", near_duplicates),
    _stage("substring_dedup", passages),
    _stage("decontamination", benchmarks),
    _stage("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# SQL cannot express the byte-pair encoding; tests/llm compares run() with brute force.
ORACLE_SQL = None
