"""The operators as queries over the driver tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from . import (
    adaptive_rules, bpe, fair_mix, hard_negatives, html_extraction, huffman, hyperminhash, quality_pu,
    sentence_spans, spelling, token_histogram, topk, url_filter,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def word_bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: (host, path, verdict) of the query's rules.
URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]


@query
def op1_url_filter(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judged_urls(table(spark, folder, "pages"), rules)


ORACLE["op1_url_filter"] = url_filter.urls_sql(URL_RULES)


@query
def op2_quality_pu(spark, folder):
    return quality_pu.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op3_fair_mix(spark, folder):
    return fair_mix.mix(table(spark, folder, "documents"))


ORACLE["op3_fair_mix"] = fair_mix.mix_sql()


@query
def op4_top_k(spark, folder):
    rows = table(spark, folder, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"))


ORACLE["op4_top_k"] = topk.topk_sql()


@query
def op5_near_duplicates(spark, folder):
    found = hyperminhash.near_duplicates(table(spark, folder, "documents"), k=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op6_bpe_round_trip(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"), word_bpe_file())


@query
def op7_token_files(spark, folder):
    # This vocabulary's ids fit two bytes; the files hold Huffman codes.
    return huffman.tokens_written_and_read(table(spark, folder, "documents"), word_bpe_file(), width=2)


@query
def op8_sentence_spans(spark, folder):
    return sentence_spans.dedup_texts(table(spark, folder, "documents"))


@query
def op9_adaptive_rules(spark, folder):
    metrics = written(adaptive_rules.metrics_of(table(spark, folder, "documents")), "rules")
    return adaptive_rules.verdicts(metrics)


ORACLE["op9_adaptive_rules"] = adaptive_rules.rules_sql()


@query
def op10_token_histogram(spark, folder):
    return token_histogram.token_counts(table(spark, folder, "documents"), word_bpe_file())


@query
def op11_hard_negatives(spark, folder):
    # Ids divisible by 7 carry the next label.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, folder, "embeddings"), label, F.col("vec_id") % 50 == 0)


ORACLE["op11_hard_negatives"] = hard_negatives.mined_sql()


@query
def op12_spelling_variants(spark, folder):
    return spelling.variants(table(spark, folder, "documents"))


@query
def op13_html_extraction(spark, folder):
    return html_extraction.extracted(table(spark, folder, "pages"))
