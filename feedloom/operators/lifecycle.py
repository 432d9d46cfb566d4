"""Run-over-run merge: new, continuing, reopened, carried, missing, closed.

Both lookups are built from the *previous* state only, so every fetched row
resolves on its own and the whole merge is joins and aggregations:

1. each fetched row contributes up to three narrow lookup rows (id, company and
   canonical URL, fingerprint); the state contributes the first row per key;
2. one equi-join over all three tiers, then the best tier per fetched row;
3. one row per resolved id (first fetched wins);
4. the winners pick the wide fetched rows; the wide state rows meet only ids.

Wide columns cross one shuffle each.  Lookup keys never hold blanks, and a key
shared by many fetched rows meets at most one state row, in as many tasks as its
rows need (`split_join`).

The merge is a plan: it runs nothing.  `keep(df, name)` may write a named step and
go on from the table; without it steps that are used more than once are computed
once per use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import utc_stamp
from ..functions.urls import canonical_url
from ..schema import RECORD_COLUMNS, conform_records
from .identity import record_fingerprint, record_id
from .joins import split_join

Keep = Callable[[DataFrame, str], DataFrame]

TIERS = ("id", "url", "fingerprint")
KEPT_ACTIVE = ("new", "continuing", "reopened", "carried", "missing")


@dataclass(frozen=True)
class Merge:
    """The merged state: record columns plus `lifecycle` and `matched_by`."""

    state: DataFrame

    @property
    def active(self) -> DataFrame:
        return self.state.where(F.col("lifecycle").isin(*KEPT_ACTIVE))

    @property
    def new(self) -> DataFrame:
        return self.state.where("lifecycle = 'new'")

    @property
    def reopened(self) -> DataFrame:
        return self.state.where("lifecycle = 'reopened'")

    @property
    def archived(self) -> DataFrame:
        return self.state.where("lifecycle IN ('archived', 'closed')")

    @property
    def closed(self) -> DataFrame:
        return self.state.where("lifecycle = 'closed'")


def state_order() -> Column:
    """The order a saved state is kept in: what "first previous row" means."""
    return F.struct(F.lower("company").alias("company"), F.col("job_id").alias("job_id"))


def _lookup_rows(df: DataFrame, *carry: str | Column) -> DataFrame:
    """One row per usable lookup key: (tier, key, carried columns)."""
    url = canonical_url(F.col("application_url"))
    keys = F.array(
        F.struct(F.lit(1).alias("tier"), F.col("job_id").alias("key")),
        # A blank URL becomes NULL and is left out: it would match everything.
        F.struct(
            F.lit(2).alias("tier"),
            F.concat(F.col("company"), F.lit("\x01"), F.nullif(url, F.lit(""))).alias("key"),
        ),
        F.struct(F.lit(3).alias("tier"), record_fingerprint().alias("key")),
    )
    exploded = df.select(*carry, F.inline(keys))
    return exploded.where(F.col("key").isNotNull())


def unkept(df: DataFrame, name: str) -> DataFrame:
    """The step as a plan."""
    return df


def _history(carry: tuple[str, ...] = ()) -> Column:
    return F.struct("job_id", "first_seen", "announced", *carry).alias("history")


def resolve(
    fetched: DataFrame, previous: DataFrame, archived: DataFrame, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Which state row each fetched row is.

    Returns (fetch_ord, own_id, rank, history): rank 1-3 is a tier of
    the active state, 4-6 a tier of the archive, NULL is unknown.
    """
    side = lambda df, scope: _lookup_rows(
        df, _history(carry), state_order().alias("ord"), F.lit(scope).alias("scope")
    )
    known = (
        side(previous, 0)
        .unionByName(side(archived, 1))
        .groupBy("tier", "key")
        .agg(
            F.min_by("history", F.when(F.col("scope") == 0, F.col("ord"))).alias("active"),
            F.min_by("history", F.when(F.col("scope") == 1, F.col("ord"))).alias("archive"),
        )
    )
    wanted = _lookup_rows(fetched, "fetch_ord", F.col("job_id").alias("own_id"))
    rank = F.when(F.col("active").isNotNull(), F.col("tier")).when(
        F.col("archive").isNotNull(), F.col("tier") + 3
    )
    candidates = split_join(wanted, known, ["tier", "key"], "left").select(
        "fetch_ord", "own_id",
        rank.alias("rank"), F.coalesce("active", "archive").alias("history"),
    )
    return candidates.groupBy("fetch_ord").agg(
        F.first("own_id").alias("own_id"),
        F.min("rank").alias("rank"),
        F.min_by("history", "rank").alias("history"),
    )


def match_tier(rank: Column) -> Column:
    """'active/id', 'archive/url', ... or 'none'."""
    names = [f"{scope}/{tier}" for scope in ("active", "archive") for tier in TIERS]
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), rank - 1), F.lit("none"))


def _winners(resolved: DataFrame, archived: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """First fetched row per resolved id, with the history it takes over.

    The archive's ids ride along in the same grouping, because a reopened row
    takes the history of the first archived row that carries its id.
    """
    rows = resolved.select(
        F.coalesce("history.job_id", "own_id").alias("job_id"), "fetch_ord", "rank", "history"
    )
    shelf = archived.select("job_id", state_order().alias("ord"), _history(carry))
    grouped = (
        rows.unionByName(shelf, allowMissingColumns=True)
        .groupBy("job_id")
        .agg(
            F.min("fetch_ord").alias("fetch_ord"),
            F.min_by(F.struct("rank", "history"), "fetch_ord").alias("first"),
            F.min_by("history", "ord").alias("shelved"),
        )
        .where("fetch_ord IS NOT NULL")
    )
    return grouped.select(
        "job_id",
        "fetch_ord",
        F.col("first.rank").alias("rank"),
        F.when(F.col("first.rank") > 3, F.col("shelved"))
        .otherwise(F.col("first.history"))
        .alias("history"),
    )


def merge_state(
    fetched: DataFrame,
    previous: DataFrame,
    archived: DataFrame,
    ok_companies: DataFrame,
    run_ts: Column,
    archive_after: int = 3,
    keep: Keep = unkept,
    carry: tuple[str, ...] = (),
) -> Merge:
    """Merge fetched rows (with a unique, sortable `fetch_ord`) into the state.

    `ok_companies(company)` names the sources that answered this run; rows of
    all other sources are carried over untouched.  `carry` names columns beyond
    the record's that both the fetched and the state rows have: the result holds
    them, and as `was_<name>` what the state held before; rows that were fetched
    also hold their `fetch_ord` then.
    """
    now = utc_stamp(run_ts)
    fetched = conform_records(fetched, "fetch_ord", *carry).withColumn("job_id", record_id())
    previous, archived = conform_records(previous, *carry), conform_records(archived, *carry)

    resolved = resolve(
        fetched.select("fetch_ord", "job_id", "company", "title", "location", "application_url"),
        previous, archived, carry,
    )
    # Narrow, and needed by all three parts below.
    winners = keep(_winners(resolved, archived, carry), "winners")

    took = fetched.drop("job_id").join(winners, "fetch_ord")
    rank, history = F.col("rank"), F.col("history")
    was = lambda of: {f"was_{c}": of(c) for c in carry}
    kept = took.withColumns(
        {
            **was(lambda c: history[c]),
            "first_seen": F.when(rank.isNull(), now).otherwise(
                F.coalesce(F.nullif(history["first_seen"], F.lit("")), now)
            ),
            "announced": F.when(rank.isNull(), F.col("announced")).otherwise(history["announced"]),
            "last_seen": now,
            "status": F.lit("active"),
            "consecutive_missing": F.lit(0),
            "lifecycle": F.when(rank.isNull(), F.lit("new"))
            .when(rank <= 3, F.lit("continuing"))
            .otherwise(F.lit("reopened")),
            "matched_by": match_tier(rank),
        }
    )

    ok = keep(ok_companies.select("company").distinct(), "ok-sources").withColumn("_ok", F.lit(True))
    # Names find out which rows are absent and whose source answered: a wide row crosses one shuffle, and none on a source's name.
    names = previous.select("job_id", "company").distinct().join(winners.select("job_id"), "job_id", "left_anti")
    absent = previous.join(split_join(names, ok, ["company"], "left"), ["job_id", "company"])
    count = F.col("consecutive_missing") + F.when(F.col("_ok"), F.lit(1)).otherwise(F.lit(0))
    closing = F.col("_ok") & (count >= archive_after)
    gone = absent.withColumns(
        {
            **was(F.col),
            "lifecycle": F.when(F.col("_ok").isNull(), F.lit("carried"))
            .when(closing, F.lit("closed"))
            .otherwise(F.lit("missing")),
            "status": F.when(closing, F.lit("closed")).otherwise(F.col("status")),
            "consecutive_missing": count,
            "matched_by": F.lit("none"),
        }
    )

    revived = winners.where(rank > 3).select("job_id")
    shelf = archived.join(revived, "job_id", "left_anti").withColumns(
        {**was(F.col), "lifecycle": F.lit("archived"), "matched_by": F.lit("none")}
    )

    columns = [*RECORD_COLUMNS, "lifecycle", "matched_by", *carry, *(f"was_{c}" for c in carry)]
    order = ["fetch_ord"] if carry else []
    return Merge(
        kept.select(*columns, *order)
        .unionByName(gone.select(columns), allowMissingColumns=True)
        .unionByName(shelf.select(columns), allowMissingColumns=True)
    )


def mark_announced(active: DataFrame, announced: DataFrame) -> DataFrame:
    """Set the flag on rows whose id was delivered in a digest."""
    sent = announced.select("job_id").distinct().withColumn("_sent", F.lit(True))
    return (
        active.join(sent, "job_id", "left")
        .withColumn("announced", F.col("announced") | F.coalesce("_sent", F.lit(False)))
        .drop("_sent")
    )
