"""The corpus pipeline: quality rules, near-dedup, substring dedup, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet to the shared
folder and reads it back as the next stage's documents.  All stages but the last return the columns of documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any
name; what becomes of them is stated in its operator's module.  Documents without words fail the base rules; where a later
stage meets them alone they stay (stage 2 keeps repeated rows once).  The last stage encodes a NULL text as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import adaptive_rules, bpe, fair_mix, hyperminhash, sentence_spans
from feedloom.llm.queries import word_bpe_file
from feedloom.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    return adaptive_rules.kept_documents(docs, written(adaptive_rules.metrics_of(docs), "rules"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8)."""
    return hyperminhash.deduplicated(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences that an earlier document, or place, already has in a repeated span."""
    return sentence_spans.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return fair_mix.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text of the mix, with digests of ids and decoded text."""
    return bpe.round_trip(docs, word_bpe_file())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("bpe_encoding", bpe_encoding),
]

#: BPE ids cannot be expressed in SQL; tests compare stages 2 to 5 with brute force, stage 1's metrics in the tests of op9.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
