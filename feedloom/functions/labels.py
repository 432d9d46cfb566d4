"""Lookup labels and score bands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a sponsorship class is shown in reports and in the explorer.
SPONSORSHIP_BADGES = {
    "likely_supported": "🟢 likely supported",
    "possibly_supported": "🟡 possibly supported",
    "unclear": "⚪ unclear",
    "likely_not_supported": "🔴 likely not supported",
    "ineligible": "⛔ ineligible",
}
SPONSORSHIP_LABELS = {
    "likely_supported": "sponsorship likely supported",
    "possibly_supported": "sponsorship possibly supported",
    "unclear": "sponsorship unclear",
    "likely_not_supported": "sponsorship likely NOT supported",
    "ineligible": "ineligible (restriction found)",
}
BANDS = ("excellent", "strong", "possible", "low")


def lookup(key: Column, table: Mapping[str, object], default: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def sponsorship_badge(classification: Column) -> Column:
    return lookup(classification, SPONSORSHIP_BADGES, classification)


def sponsorship_label(classification: Column) -> Column:
    return lookup(classification, SPONSORSHIP_LABELS, classification)


def score_band(score: Column, thresholds: Mapping[str, int]) -> Column:
    excellent, strong, possible, low = BANDS
    return (
        F.when(score >= thresholds[excellent], F.lit(excellent))
        .when(score >= thresholds[strong], F.lit(strong))
        .when(score >= thresholds[possible], F.lit(possible))
        .otherwise(F.lit(low))
    )
