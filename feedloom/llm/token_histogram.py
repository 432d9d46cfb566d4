"""Token counts as an exact length histogram.

Documents are aggregated by their encoded length.  From the histogram, running sums answer for every context limit L
how many documents are at most, or longer than, L; how many tokens there are in all; how many stay if each document is cut to L;
and the share of documents up to L, from which any quantile is read.

The histogram is combined before the shuffle and has one row per different length.  Running sums go over slices of `SLICE`
lengths, so no task holds more than a slice and the narrow table of slices.

NULL texts and texts without words have length 0 and are counted.  Repeated rows count as often as they occur.  An empty table gives
an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import per_batch, running_sum

SLICE = 1024


def lengths(docs: DataFrame, file: str, text_col: str = "text") -> DataFrame:
    """(n_tokens) per document."""
    from .lib_words import library_codec

    def run(cols):
        ends = library_codec(file).encode_all(cols["text"])[1]
        return {"n_tokens": np.diff(ends, prepend=0)}

    schema = pa.schema([("n_tokens", pa.int64())])
    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(per_batch(run, schema), "n_tokens long")


def histogram(rows: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): one row per different length."""
    return rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def answers(hist: DataFrame) -> DataFrame:
    """Per length, as a context limit: documents up to it and above it, tokens in all, tokens left when cut to it, share.

    Suffix sums (documents and tokens above a length) are the totals less the prefix sums.
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    totals = hist.agg(F.sum("n_docs").alias("_docs"), F.sum(tokens).alias("_tokens"))
    slices = F.floor(F.col("n_tokens") / SLICE).cast("long")
    rows = running_sum(hist, [], slices, [F.col("n_tokens")], F.col("n_docs"), "_s", "_docs_before").drop("_bucket", "_s")
    rows = running_sum(rows, [], slices, [F.col("n_tokens")], tokens, "_s", "_tokens_before").drop("_bucket", "_s")
    rows = rows.withColumn("_one", F.lit(1)).join(totals.withColumn("_one", F.lit(1)), "_one")
    upto = F.col("_docs_before") + F.col("n_docs")
    return rows.select(
        "n_tokens", "n_docs", upto.alias("docs_up_to"), (F.col("_docs") - upto).alias("docs_above"),
        F.col("_tokens").alias("total_tokens"),
        (F.col("_tokens_before") + tokens + F.col("n_tokens") * (F.col("_docs") - upto)).alias("truncated_tokens"),
        (upto / F.col("_docs")).alias("share_up_to"),
    )


def token_counts(docs: DataFrame, file: str) -> DataFrame:
    return answers(written(histogram(lengths(docs, file)), "lengths"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_up_to, docs_above, total_tokens, truncated_tokens) for any limits, also between lengths.

    One pass over the histogram, combined before the shuffle; one row per limit of the given list.
    """
    each = hist.withColumn("context_limit", F.explode(F.array(*[F.lit(int(x)) for x in limits])))
    fits = F.col("n_tokens") <= F.col("context_limit")
    return each.groupBy("context_limit").agg(
        F.sum(F.when(fits, F.col("n_docs")).otherwise(0)).alias("docs_up_to"),
        F.sum(F.when(fits, 0).otherwise(F.col("n_docs"))).alias("docs_above"),
        F.sum(F.col("n_tokens") * F.col("n_docs")).alias("total_tokens"),
        F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("truncated_tokens"),
    )


def quantiles(answer: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that so many of the documents do not exceed."""
    return answer.select(F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"), "share_up_to", "n_tokens").where(
        "share_up_to >= share"
    ).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
