"""Ordering, top-k, explorer filters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_ordinal
from ..functions.text import text_or_empty
from ..rules import RulePack
from .classify import family
from .gates import with_source

DEFAULT_PRIORITY = 9


def with_priority(df: DataFrame, sources: DataFrame) -> DataFrame:
    return with_source(df, sources, "priority").withColumn(
        "priority", F.coalesce("priority", F.lit(DEFAULT_PRIORITY))
    )


def recommended_order() -> list[Column]:
    """Score, posting date, source priority, source name; the id breaks ties."""
    return [
        F.col("overall_score").desc(),
        date_ordinal(F.col("date_posted")).desc(),
        F.col("priority").asc(),
        F.lower("company").asc(),
        F.col("job_id").asc(),
    ]


def sort_recommended(df: DataFrame, sources: DataFrame) -> DataFrame:
    return with_priority(df, sources).orderBy(*recommended_order())


def top_with_rest(df: DataFrame, order: list[Column], n: int, label: Column) -> DataFrame:
    """The first `n` lines and one line that counts the others.

    The top rows are a TakeOrdered plan; the count is an independent aggregate.
    """
    top = df.orderBy(*order).limit(n).select(F.lit("row").alias("kind"), label.alias("line"))
    rest = (
        df.agg(F.count(F.lit(1)).alias("total"))
        .where(F.col("total") > n)
        .select(
            F.lit("rest").alias("kind"),
            F.concat(F.lit("…and "), (F.col("total") - n).cast("string"), F.lit(" more")).alias("line"),
        )
    )
    return top.unionByName(rest)


@dataclass(frozen=True)
class Explore:
    """Optional explorer conditions; unset ones do not filter."""

    query: str = ""
    company: str = ""
    min_score: int = 0
    sponsorship: str = ""
    location: str = ""
    family: str = ""
    new_only: bool = False
    show_disqualified: bool = False

    def condition(self, pack: RulePack) -> Column:
        tests = [F.col("overall_score") >= self.min_score]
        if not self.show_disqualified:
            tests.append(~F.col("disqualified"))
        needle = self.query.strip().lower()
        if needle:
            tests.append(F.contains(F.lower("title"), F.lit(needle)) | F.contains(F.lower("company"), F.lit(needle)))
        if self.company:
            tests.append(F.col("company") == self.company)
        if self.sponsorship:
            tests.append(F.col("sponsorship_classification") == self.sponsorship)
        place = self.location.strip().lower()
        if place:
            tests.append(F.contains(F.lower(text_or_empty(F.col("location"))), F.lit(place)))
        if self.family:
            tests.append(family(F.col("title"), pack) == self.family)
        return reduce(Column.__and__, tests)


def explorer_order(by: str) -> list[Column]:
    score, date = F.col("overall_score").desc(), text_or_empty(F.col("date_posted")).desc()
    keys = {
        "score": [score, date],
        "date": [date, score],
        "company": [F.lower("company").asc(), F.col("company").asc(), score],
    }
    return [*keys[by], F.col("job_id").asc()]


def only_new(active: DataFrame, new: DataFrame) -> DataFrame:
    return active.join(new.select("job_id"), "job_id", "left_semi")


def explore(
    active: DataFrame, new: DataFrame, conditions: Explore, pack: RulePack,
    by: str = "score", limit: int | None = None,
) -> DataFrame:
    """All rows that match, in explorer order; only an explicit `limit` cuts them."""
    found = active.where(conditions.condition(pack))
    if conditions.new_only:
        found = only_new(found, new)
    ordered = found.orderBy(*explorer_order(by))
    return ordered if limit is None else ordered.limit(limit)


def explore_page(
    active: DataFrame, new: DataFrame, conditions: Explore, pack: RulePack, by: str, size: int,
) -> DataFrame:
    """The first `size` rows that match, in explorer order, each with `matched`, the number of all that do.

    The count needs the tested columns only; the page, at most `size` rows, is ordered after they meet.
    """
    found = explore(active, new, conditions, pack, by)
    total = found.agg(F.count(F.lit(1)).alias("matched")).withColumn("_one", F.lit(1))
    page = found.limit(size).withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")
    return page.orderBy(*explorer_order(by))
