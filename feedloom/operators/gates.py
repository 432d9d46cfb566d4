"""Gates: which records enter the dataset, and why."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_prefix
from ..functions.text import any_word_hit, let, strip_ws, text_or_empty, word_hits_in
from ..rules import RulePack


def clean_identity(df: DataFrame) -> DataFrame:
    """Trim title and URL; rows without a title are dropped."""
    return df.withColumns(
        {"title": strip_ws(F.col("title")), "application_url": strip_ws(F.col("application_url"))}
    ).where(F.col("title") != "")


def location_matches(location: Column, country: Column, allowed: Column) -> Column:
    """Whether a record's place is acceptable for its source; the order matters."""
    country = text_or_empty(country)
    both = F.lower(F.concat_ws(" ", text_or_empty(location), country))
    return (
        F.when(F.contains(F.lower(country), F.lit("united states")), F.lit(True))
        .when(F.coalesce(F.size(allowed), F.lit(0)) <= 0, F.lit(True))
        .when(strip_ws(both) == "", F.lit(False))
        .when(any_word_hit(both, allowed), F.lit(True))
        .otherwise(F.contains(both, F.lit("remote")) & (country == ""))
    )


def posted_since(date_posted: Column, bound: str) -> Column:
    """Known dates before the bound fail; unknown dates pass."""
    if not bound:
        return F.lit(True)
    return (text_or_empty(date_posted) == "") | (iso_prefix(date_posted) >= bound)


def title_decision(title: Column, pack: RulePack) -> Column:
    """struct(passed, matched, excluded); level terms come before role terms."""

    def decide(low: Column) -> Column:
        hits = F.struct(
            word_hits_in(low, [*pack.include_level, *pack.include_role]).alias("matched"),
            word_hits_in(low, pack.exclude).alias("excluded"),
        )
        return let(
            hits,
            lambda h: F.struct(
                ((F.size(h["matched"]) > 0) & (F.size(h["excluded"]) == 0)).alias("passed"),
                h["matched"].alias("matched"),
                h["excluded"].alias("excluded"),
            ),
        )

    return let(F.lower(title), decide)


def with_title_decision(df: DataFrame, pack: RulePack) -> DataFrame:
    return df.withColumn("decision", title_decision(F.col("title"), pack))


def title_prefilter(title: Column, pack: RulePack) -> Column:
    return title_decision(title, pack)["passed"]


def default_country(df: DataFrame, pack: RulePack) -> DataFrame:
    return df.withColumn(
        "country",
        F.when(text_or_empty(F.col("country")) == "", F.lit(pack.default_country)).otherwise(
            F.col("country")
        ),
    )


def with_source(df: DataFrame, sources: DataFrame, *columns: str | Column) -> DataFrame:
    """Attach columns of the source dimension.

    No hint: the planner broadcasts the dimension while its measured size allows
    and falls back to a shuffle join, whose skewed partitions AQE splits.
    """
    dim = sources.select(F.col("name").alias("company"), *columns)
    return df.join(dim, "company", "left")


def gate(df: DataFrame, sources: DataFrame, pack: RulePack) -> DataFrame:
    """All gates in cost order: blank title, place, date, title terms.

    Keeps `decision`, and sets `excluded_keywords` and the default country.
    """
    placed = with_source(clean_identity(df), sources, F.col("locations").alias("_allowed")).where(
        location_matches(F.col("location"), F.col("country"), F.col("_allowed"))
        & posted_since(F.col("date_posted"), pack.min_posted_date)
    )
    decided = with_title_decision(default_country(placed, pack), pack).where("decision.passed")
    return decided.withColumn("excluded_keywords", F.col("decision.excluded")).drop("_allowed")


def only_companies(sources: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Case-insensitive subset of the source dimension."""
    return sources.where(F.lower("name").isin([w.lower() for w in wanted]))


def unknown_companies(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """Wanted names that no source carries (set difference, as an anti join)."""
    known = sources.select(F.lower("name").alias("name"))
    return wanted.select(F.lower("name").alias("name")).distinct().join(known, "name", "left_anti")


def skipped_source(enabled: Column, source_type: Column) -> Column:
    return ~F.coalesce(enabled, F.lit(True)) | (source_type == "unresolved")


def visible(df: DataFrame) -> DataFrame:
    return df.where(~F.col("disqualified"))


def digest_eligible(df: DataFrame, pack: RulePack) -> DataFrame:
    """New, not disqualified, good enough and not announced yet."""
    return df.where(
        (F.col("lifecycle") == "new")
        & ~F.col("disqualified")
        & (F.col("overall_score") >= pack.digest_min_score)
        & ~F.col("announced")
    )
