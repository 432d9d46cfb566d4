"""Detail enrichment of listings, under a title/place predicate and an optional cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import Cap, first_n_per_key


def eligible_for_detail(
    listing: DataFrame, predicate: Column, order: list[str | Column], key: str, cap: int | Cap | None = None
) -> DataFrame:
    """(company, key) of the rows per source that pass the predicate, all or the first `cap`.

    The predicate runs below the window, and a cap, also each source's own (`Cap`), is
    a group limit applied before the shuffle, so a hot source costs one short list per task.
    Rows of a source without a cap pass as they are.
    """
    wanted = listing.where(predicate)
    if cap is not None:
        wanted = first_n_per_key(wanted, ["company"], order, cap)
    return wanted.select("company", key)


def enrich(
    listing: DataFrame, details: DataFrame, predicate: Column, order: list[str | Column],
    key: str, cap: int | Cap | None = None,
) -> DataFrame:
    """Listing left-joined to its allowed details; `detail` is a struct or NULL."""
    allowed = eligible_for_detail(listing, predicate, order, key, cap)
    payload = [c for c in details.columns if c not in ("company", key)]
    found = details.join(allowed, ["company", key], "left_semi").select(
        "company", key, F.struct(*payload).alias("detail")
    )
    return listing.join(found, ["company", key], "left")
