"""Counts: run summary, report summary, source checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import BANDS, score_band
from ..rules import RulePack
from .health import is_ok
from .lifecycle import KEPT_ACTIVE


def _one_row(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """Merge one-row counts of several tables into one row, without a cross join.

    Each part is (metric, n) rows; the final aggregation sees one row per metric.
    """
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.agg(
        *[F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("n"))), F.lit(0)).cast("bigint").alias(m) for m in names]
    )


def _metrics(df: DataFrame, **conditions: Column) -> DataFrame:
    """Count rows per condition in one pass, as (metric, n) rows."""
    counted = df.agg(*[F.count_if(c).alias(m) for m, c in conditions.items()])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("n")) for m in conditions])
    return counted.select(F.inline(rows))


def run_summary(health: DataFrame, state: DataFrame, pack: RulePack) -> DataFrame:
    """The seven counts of a run: one pass over health, one over the state."""
    status, life = F.col("status"), F.col("lifecycle")
    sources = _metrics(
        health,
        companies_checked=is_ok(status),
        companies_failed=status == "failed",
        companies_skipped=status == "skipped",
    )
    records = _metrics(
        state,
        active_jobs=life.isin(*KEPT_ACTIVE),
        new_jobs=life == "new",
        closed_jobs=life == "closed",
        digest_jobs=(life == "new")
        & ~F.col("disqualified")
        & (F.col("overall_score") >= pack.digest_min_score)
        & ~F.col("announced"),
    )
    names = ["companies_checked", "companies_failed", "companies_skipped",
             "active_jobs", "new_jobs", "closed_jobs", "digest_jobs"]
    return _one_row([sources, records], names)


def report_summary(active: DataFrame, health: DataFrame, pack: RulePack) -> DataFrame:
    """Totals of the report: tracked, recommended, source states, rows per band."""
    band, seen = score_band(F.col("overall_score"), pack.thresholds), ~F.col("disqualified")
    records = _metrics(
        active,
        active_jobs=F.lit(True),
        recommended=seen,
        **{f"{name}_jobs": seen & (band == name) for name in BANDS},
    )
    status = F.col("status")
    sources = _metrics(
        health, sources_ok=is_ok(status), sources_failed=status == "failed",
        sources_skipped=status == "skipped",
    )
    names = ["active_jobs", "recommended", *[f"{n}_jobs" for n in BANDS],
             "sources_ok", "sources_failed", "sources_skipped"]
    return _one_row([records, sources], names)


def band_counts(records: DataFrame, pack: RulePack) -> DataFrame:
    banded = records.select(score_band(F.col("overall_score"), pack.thresholds).alias("band"))
    return banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def companies(records: DataFrame) -> DataFrame:
    return records.select("company").distinct().orderBy("company")


def duplicate_names(sources: DataFrame) -> DataFrame:
    counts = sources.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1")


def invalid_sources(sources: DataFrame, allowed_types: list[str]) -> DataFrame:
    """Data-quality check of the source dimension: violating rows with a reason."""
    name = F.trim(F.coalesce("name", F.lit("")))
    reason = F.when(name == "", F.lit("blank name")).when(
        ~F.coalesce("source_type", F.lit("unresolved")).isin(allowed_types), F.lit("unknown source type")
    )
    return sources.select(name.alias("name"), "source_type", reason.alias("reason")).where("reason IS NOT NULL")


def source_validation(outcomes: DataFrame, records: DataFrame, sources: DataFrame, order: str) -> DataFrame:
    """Try-every-source report: status with row count and first title, message, or note of a source left out."""
    seen = records.groupBy("company").agg(
        F.count(F.lit(1)).alias("rows"), F.min_by("title", order).alias("first_title")
    )
    listed = sources.select(F.col("name").alias("company"), "enabled", F.coalesce("notes", F.lit("")).alias("notes"))
    joined = outcomes.join(listed, "company").join(seen, "company", "left")
    rows = F.coalesce("rows", F.lit(0))
    status = F.col("status")
    unresolved = F.coalesce(F.col("source_type") == "unresolved", F.lit(False))
    disabled = ~F.coalesce("enabled", F.lit(True))
    return joined.select(
        "company",
        F.when(unresolved, F.lit("unresolved"))
        .when(disabled, F.lit("disabled"))
        .when(status == "failed", F.concat(F.lit("FAILED ("), F.col("error_category"), F.lit(")")))
        .otherwise(F.concat(F.lit("ok ("), rows.cast("string"), F.lit(" jobs)")))
        .alias("result"),
        F.when(unresolved | disabled, F.col("notes"))
        .when(is_ok(status), F.left(F.coalesce("first_title", F.lit("")), F.lit(80)))
        .otherwise(F.left(F.col("error_message"), F.lit(160)))
        .alias("detail"),
        F.when(status == "failed", F.lit(1)).otherwise(F.lit(0)).alias("failing"),
    )


def failing_sources(validation: DataFrame) -> DataFrame:
    return validation.agg(F.coalesce(F.sum("failing"), F.lit(0)).cast("bigint").alias("failing"))
