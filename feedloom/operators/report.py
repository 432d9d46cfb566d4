"""Report lines as text columns; one row per line, ranked by the sort columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import score_band, sponsorship_badge, sponsorship_label
from ..functions.text import first_filled, md_escape, text_or_empty, truncate
from ..rules import RulePack
from .gates import digest_eligible, visible
from .rank import recommended_order, with_priority

NO_NEW_ROWS = "No new matching jobs were discovered in this run."
LISTED_BANDS = ("excellent", "strong", "possible")


def _cells(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _link() -> Column:
    return F.concat(F.lit("[Apply]("), F.col("application_url"), F.lit(")"))


def _place() -> Column:
    return md_escape(truncate(F.col("location"), 60))


def active_line() -> Column:
    """Six cells: link, company, title, place, sponsorship badge, date."""
    return _cells(
        _link(), md_escape(F.col("company")), md_escape(F.col("title")), _place(),
        sponsorship_badge(F.col("sponsorship_classification")),
        first_filled(F.col("date_posted"), F.lit("—")),
    )


def digest_line() -> Column:
    """Seven cells: as above with the score, and the reason instead of the date."""
    reason = first_filled(F.col("sponsorship_evidence"), F.col("score_explanation"))
    return _cells(
        _link(), md_escape(F.col("company")), md_escape(F.col("title")), _place(),
        F.col("overall_score").cast("string"),
        sponsorship_badge(F.col("sponsorship_classification")),
        md_escape(truncate(reason, 160)),
    )


def chat_line() -> Column:
    """One line of the short chat digest."""
    place = first_filled(F.col("location"), F.lit("location n/a"))
    return F.concat(
        F.lit("• "), F.col("company"), F.lit(" — "), F.col("title"), F.lit(" ("), place,
        F.lit(") score "), F.col("overall_score").cast("string"), F.lit(" ["),
        F.col("sponsorship_classification"), F.lit("]\n  "), F.col("application_url"),
    )


def _lines(df: DataFrame, line: Column, *extra: Column) -> DataFrame:
    return df.select(*extra, "overall_score", "date_posted", "priority", "company", "job_id", line.alias("line"))


def report_lines(active: DataFrame, sources: DataFrame, pack: RulePack) -> DataFrame:
    """Lines of the active report with their section, in order; low rows are only counted."""
    band = score_band(F.col("overall_score"), pack.thresholds)
    shown = with_priority(visible(active), sources).withColumn("band", band).where(
        F.col("band").isin(*LISTED_BANDS)
    )
    section = F.array_position(F.array(*[F.lit(b) for b in LISTED_BANDS]), F.col("band"))
    return _lines(shown, active_line(), F.col("band")).orderBy(section, *recommended_order())


def new_report_lines(new: DataFrame, sources: DataFrame) -> DataFrame:
    """Lines of the new-rows report in order, or one line that says there are none."""
    shown = _lines(with_priority(visible(new), sources), active_line())
    empty = visible(new).agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    notice = empty.select(F.lit(NO_NEW_ROWS).alias("line"))
    return shown.unionByName(notice, allowMissingColumns=True).orderBy(*recommended_order())


def digest_lines(state: DataFrame, sources: DataFrame, pack: RulePack) -> DataFrame:
    lines = _lines(with_priority(digest_eligible(state, pack), sources), digest_line())
    return lines.orderBy(*recommended_order())


def explorer_view(df: DataFrame, new: DataFrame) -> DataFrame:
    """What the explorer shows per record: label, evidence or inference, new mark."""
    fresh = new.select("job_id", F.lit(True).alias("is_new"))
    found = text_or_empty(F.col("sponsorship_evidence"))
    return df.join(fresh, "job_id", "left").withColumns(
        {
            "is_new": F.coalesce("is_new", F.lit(False)),
            "sponsorship_label": sponsorship_label(F.col("sponsorship_classification")),
            "evidence_line": F.when(found != "", found).otherwise(
                F.lit("No explicit sponsorship language found in the posting text.")
            ),
        }
    )
