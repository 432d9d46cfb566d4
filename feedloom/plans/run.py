"""One run: landed pages -> records -> gates -> classes -> score -> merge -> outputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import utc_stamp
from ..operators import gates, health, lifecycle, summary
from ..operators.classify import with_graduation, with_sponsorship
from ..operators.identity import with_record_id
from ..operators.refine import FrameRefiner, refine
from ..operators.score import with_score
from ..rules import POSTING, RulePack
from ..schema import conform_records
from ..session import remove
from ..sources import boards, endpoints, pages  # noqa: F401  (registers them)
from ..sources.landing import Context, Normalized, normalize
from ..sources.ledger import Ledger, run_ledger
from ..sources.state import load_health, load_records, save_health, write_outputs


def judge_records(
    records: DataFrame, sources: DataFrame, pack: RulePack, run_ts: Column,
    refiner: FrameRefiner | None = None,
) -> DataFrame:
    """Gate, classify, score and identify; one narrow stage plus the source join.

    `records` carry `fetch_ord`; the result keeps it.
    """
    kept = gates.gate(conform_records(records, "fetch_ord"), sources, pack)
    judged = with_score(with_sponsorship(with_graduation(kept, pack), pack), pack, run_ts)
    done = conform_records(judged, "fetch_ord")
    return with_record_id(refine(done, refiner))


@dataclass(frozen=True)
class Run:
    """Results of a run as DataFrames; nothing is computed until they are used."""

    merge: lifecycle.Merge
    health: DataFrame
    normalized: Normalized
    pack: RulePack

    @property
    def summary(self) -> DataFrame:
        return summary.run_summary(self.health, self.merge.state, self.pack)

    @property
    def digest(self) -> DataFrame:
        return gates.digest_eligible(self.merge.state, self.pack)


@dataclass(frozen=True)
class Fetched:
    """What a run's pages gave: judged rows, and how each source did."""

    normalized: Normalized
    outcomes: DataFrame
    judged: DataFrame

    @property
    def ok_companies(self) -> DataFrame:
        return self.outcomes.where(health.is_ok(F.col("status"))).select("company")


def judge_pages(payloads: DataFrame, ctx: Context, refiner: FrameRefiner | None = None) -> Fetched:
    """Landed pages -> records -> gates -> classes -> score, each step through the context's `keep`.

    A kept source dimension has a known size, so that joins with it are planned as broadcasts where
    it is small, and no text moves on a source's name.
    """
    keep = ctx.keep
    ctx = replace(ctx, sources=keep(ctx.sources, "sources"))
    found = normalize(payloads, ctx)
    found = Normalized(keep(found.records, "normalized"), keep(found.problems, "problems"))
    records = found.accepted(keep)
    outcomes = keep(health.run_outcomes(ctx.sources, payloads, records, found.problems), "outcomes")
    return Fetched(found, outcomes, keep(judge_records(records, ctx.sources, ctx.pack, ctx.run_ts, refiner), "judged"))


def plan_run(
    payloads: DataFrame, ctx: Context, previous: DataFrame, archived: DataFrame,
    previous_health: DataFrame, refiner: FrameRefiner | None = None,
) -> Run:
    """Plan of a run.  The context's `keep` may write named steps and go on from the tables;
    without one the plan runs and writes nothing.
    """
    done = judge_pages(payloads, ctx, refiner)
    merge = lifecycle.merge_state(
        done.judged, previous, archived, done.ok_companies, ctx.run_ts, ctx.pack.archive_after_missing_runs, ctx.keep
    )
    now = health.step(previous_health, done.outcomes, utc_stamp(ctx.run_ts))
    return Run(merge, now, done.normalized, ctx.pack)


def _in_scope(sources: DataFrame, only: list[str] | None) -> DataFrame:
    """The sources of this run; an unknown name is an error."""
    if not only:
        return sources
    wanted = sources.sparkSession.createDataFrame([(n,) for n in only], "name STRING")
    unknown = [r["name"] for r in gates.unknown_companies(wanted, sources).orderBy("name").take(len(only))]
    if unknown:
        raise ValueError(f"unknown companies: {', '.join(unknown)}")
    return gates.only_companies(sources, only)


def keep_in(folder: str) -> Callable[..., DataFrame]:
    """A `keep` that writes a step's result to a folder and goes on from the table: it is computed once."""

    def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    return keep


def run_once(
    payloads: DataFrame, sources: DataFrame, state: str, target: str, run_ts: Column, *,
    details: DataFrame | None = None, pack: RulePack = POSTING,
    configs: dict[str, dict] | None = None, refiner: FrameRefiner | None = None,
    only: list[str] | None = None, dry_run: bool = False,
    deliver: Callable[[DataFrame], bool] | None = None,
) -> Run:
    """Run against the state saved in `state` and write all outputs to `target`.

    The two folders differ, so a run never overwrites what it reads and a failed
    run can be repeated.  Steps that several outputs need are kept in `target/steps`, so
    pages are parsed and texts scored once, and removed when all outputs are written.  A dry
    run writes nothing anywhere.
    """
    spark = payloads.sparkSession
    steps = f"{target}/steps"
    ctx = Context(_in_scope(sources, only), run_ts, details, pack, configs or {})
    if not dry_run:
        ctx = replace(ctx, keep=keep_in(steps))
    run = plan_run(
        payloads, ctx,
        load_records(spark, f"{state}/active"), load_records(spark, f"{state}/archived"),
        load_health(spark, f"{state}/health"), refiner,
    )
    if dry_run:
        return run
    found = Normalized(*[
        keep_in(target)(df, name) for df, name in ((run.normalized.records, "normalized"), (run.normalized.problems, "problems"))
    ])
    merge, now = write_outputs(run.merge, run.health, sources, target, run_ts, pack, deliver)
    remove(spark, steps)
    return Run(merge, now, found, pack)


@dataclass(frozen=True)
class LedgerRun:
    """Results of a run that appended to a ledger."""

    changes: DataFrame
    health: DataFrame
    pack: RulePack

    @property
    def digest(self) -> DataFrame:
        return gates.digest_eligible(self.changes, self.pack)


def run_next(
    payloads: DataFrame, sources: DataFrame, ledger: Ledger, run_ts: Column, *,
    details: DataFrame | None = None, pack: RulePack = POSTING,
    configs: dict[str, dict] | None = None, refiner: FrameRefiner | None = None,
    only: list[str] | None = None, version: int | None = None,
) -> LedgerRun:
    """The next run of a ledger: it writes what changed, not the whole state.

    Health is a table per version beside the ledger's.  A run that failed is repeated under its `version`.
    """
    spark, root = payloads.sparkSession, ledger.root
    ledger.start()
    number = version or ledger.newest() + 1
    steps = f"{root}/steps/{number}"
    ctx = Context(_in_scope(sources, only), run_ts, details, pack, configs or {}, keep_in(steps))
    done = judge_pages(payloads, ctx, refiner)
    changes = run_ledger(
        ledger, number, done.judged, done.ok_companies, run_ts, pack.archive_after_missing_runs, ctx.keep
    )
    now = health.step(load_health(spark, f"{root}/health/{number - 1}"), done.outcomes, utc_stamp(run_ts))
    save_health(now, f"{root}/health/{number}", run_ts)
    remove(spark, steps)
    return LedgerRun(changes, load_health(spark, f"{root}/health/{number}"), pack)


def validate_sources(
    payloads: DataFrame, sources: DataFrame, run_ts: Column, *, details: DataFrame | None = None,
    pack: RulePack = POSTING, configs: dict[str, dict] | None = None,
) -> DataFrame:
    """Try every source and report what happened; reads only."""
    found = normalize(payloads, Context(sources, run_ts, details, pack, configs or {}))
    records = found.accepted()
    outcomes = health.run_outcomes(sources, payloads, records, found.problems)
    return summary.source_validation(outcomes, records, sources, "fetch_ord")
