"""Date functions.  Records keep dates as ISO text, the empty text for unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_empty

ISO = "yyyy-MM-dd"


def iso_prefix(value: Column) -> Column:
    return F.left(text_or_empty(value), F.lit(10))


def parse_iso(value: Column) -> Column:
    """The DATE in the first ten characters, NULL when there is none."""
    return F.try_to_date(iso_prefix(value), ISO)


def _iso_text(value: Column) -> Column:
    return F.coalesce(F.date_format(value, ISO), F.lit(""))


def epoch_seconds_date(value: Column) -> Column:
    seconds = value.try_cast("bigint")
    return F.when(seconds > 0, _iso_text(F.timestamp_seconds(seconds))).otherwise(F.lit(""))


def epoch_millis_date(value: Column) -> Column:
    millis = value.try_cast("bigint")
    return F.when(millis != 0, _iso_text(F.timestamp_millis(millis))).otherwise(F.lit(""))


def us_date(value: Column) -> Column:
    """'July 10, 2026', 'Jul 10, 2026' or ISO text as ISO text, else empty."""
    text = F.trim(value)
    return _iso_text(
        F.coalesce(
            F.try_to_date(text, "MMMM d, yyyy"),
            F.try_to_date(text, "MMM d, yyyy"),
            F.try_to_date(text, "yyyy-M-d"),
        )
    )


def relative_date(value: Column, run_ts: Column) -> Column:
    """'Posted 3 Days Ago' and its kin, counted back from the run's date."""
    low = F.lower(text_or_empty(value))
    days = F.regexp_extract(low, r"([0-9]+)\+?\s*day", 1).try_cast("int")
    back = (
        F.when(F.contains(low, F.lit("today")), F.lit(0))
        .when(F.contains(low, F.lit("yesterday")), F.lit(1))
        .when(days.isNotNull(), days)
        .when(F.contains(low, F.lit("30+")), F.lit(31))
    )
    return _iso_text(F.date_sub(F.to_date(run_ts), back))


def age_days(date_posted: Column, run_ts: Column) -> Column:
    """Whole days since posting, never negative, NULL when the date is unknown."""
    posted = parse_iso(date_posted)
    return F.when(posted.isNotNull(), F.greatest(F.lit(0), F.datediff(F.to_date(run_ts), posted)))


def date_ordinal(date_posted: Column) -> Column:
    """A number that sorts like the date; an invalid date counts as the epoch."""
    return F.coalesce(F.unix_date(parse_iso(date_posted)), F.lit(0))


def utc_stamp(run_ts: Column) -> Column:
    return F.date_format(run_ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_stamps(run_ts: Column, zone: str = "Asia/Taipei") -> tuple[Column, Column]:
    """The run's time as shown in reports: UTC, and a local zone."""
    shape = "yyyy-MM-dd HH:mm"
    return (
        F.concat(F.date_format(run_ts, shape), F.lit(" UTC")),
        F.concat(F.date_format(F.from_utc_timestamp(run_ts, zone), shape), F.lit(f" {zone}")),
    )
