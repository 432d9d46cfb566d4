"""Stable identities: fingerprint, record id, first-wins de-duplication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug, strip_ws, text_or_empty


def fingerprint(
    company: Column, title: Column, location: Column, application_url: Column
) -> Column:
    parts = [F.lower(strip_ws(text_or_empty(c))) for c in (company, title, location, application_url)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def record_fingerprint() -> Column:
    return fingerprint(
        F.col("company"), F.col("title"), F.col("location"), F.col("application_url")
    )


def record_id(fingerprint_column: Column | None = None) -> Column:
    """Existing id, else source id, else the start of the fingerprint."""
    fp = record_fingerprint() if fingerprint_column is None else fingerprint_column
    own = F.when(text_or_empty(F.col("source_job_id")) != "", F.col("source_job_id")).otherwise(
        F.left(fp, F.lit(16))
    )
    return F.when(text_or_empty(F.col("job_id")) != "", F.col("job_id")).otherwise(
        F.concat(slug(F.col("company")), F.lit("-"), own)
    )


def with_record_id(df: DataFrame) -> DataFrame:
    return df.withColumn("job_id", record_id())


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row per key; rows with a blank key are dropped.

    The planner turns `row_number() = 1` into a group limit that runs before the
    shuffle, so a key that holds a third of all rows sends one row per task.
    """
    present = df
    for key in keys:
        present = present.where(text_or_empty(F.col(key).cast("string")) != "")
    window = Window.partitionBy(*keys).orderBy(*order)
    return present.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


@dataclass(frozen=True)
class Cap:
    """How many rows each key may have: a column (NULL: all of them), and the most it can say."""

    each: Column
    most: int


def first_n_per_key(df: DataFrame, keys: list[str], order: list[str | Column], n: int | Cap) -> DataFrame:
    """First `n` rows per key, in two phases: the first ones of a key per task, then the first ones of those.

    The planner makes the first phase of a constant bound (a group limit before the shuffle; up to
    `spark.sql.optimizer.windowGroupLimitThreshold`, 1000).  Where every key has a cap of its own, the greatest
    cap is that bound, and rows of keys without a cap never enter the window.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    numbered = lambda rows: rows.withColumn("_nth", F.row_number().over(window))
    if not isinstance(n, Cap):
        return numbered(df).where(F.col("_nth") <= n).drop("_nth")
    rows = df.withColumn("_cap", n.each)
    capped = numbered(rows.where("_cap IS NOT NULL")).where(F.col("_nth") <= n.most).where("_nth <= _cap")
    return capped.drop("_nth", "_cap").unionByName(rows.where("_cap IS NULL").drop("_cap"))
