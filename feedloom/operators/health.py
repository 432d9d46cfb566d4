"""Per-source health: one-step update and the fold of a whole run log.

A run log has (company, run_ts, run_id, status, jobs_fetched); `run_id` breaks
ties between runs of one moment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_filled, md_escape, truncate
from ..schema import HEALTH_COLUMNS, conform_health
from .gates import skipped_source
from .joins import split_join


def is_ok(status: Column) -> Column:
    return status.isin("ok", "ok_empty")


def success_status(jobs_fetched: Column) -> Column:
    return F.when(jobs_fetched > 0, F.lit("ok")).otherwise(F.lit("ok_empty"))


def rows_per_source(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Listing size per source, zero for sources without rows."""
    counts = records.groupBy("company").agg(F.count(F.lit(1)).alias("jobs_fetched"))
    return sources.select(F.col("name").alias("company")).join(counts, "company", "left").select(
        "company", F.coalesce("jobs_fetched", F.lit(0)).alias("jobs_fetched")
    )


def run_outcomes(
    sources: DataFrame, pages: DataFrame, records: DataFrame, problems: DataFrame
) -> DataFrame:
    """This run's status and category per source.

    `problems(company, category, message)` comes from the structure checks and
    from landed fetch errors.  A source without any landed page was not reached;
    all others succeeded, with or without rows.
    """
    counted = rows_per_source(records, sources).withColumnRenamed("company", "name")
    failed = problems.groupBy(F.col("company").alias("name")).agg(
        F.min_by("category", F.struct("message", "category")).alias("_category"),
        F.min("message").alias("_message"),
    )
    reached = pages.select(F.col("company").alias("name")).distinct().withColumn("_reached", F.lit(True))
    joined = sources.join(counted, "name").join(failed, "name", "left").join(reached, "name", "left")
    skipped = skipped_source(F.col("enabled"), F.col("source_type"))
    category = F.coalesce("_category", F.when(F.col("_reached").isNull(), F.lit("network_error")))
    message = F.coalesce("_message", F.concat(F.col("name"), F.lit(": no page landed")))
    good = success_status(F.col("jobs_fetched"))

    def by_case(on_skip: Column, on_fail: Column, on_ok: Column) -> Column:
        return F.when(skipped, on_skip).when(category.isNotNull(), on_fail).otherwise(on_ok)

    note = first_filled(F.col("notes"), F.lit("disabled in the source list"))
    return joined.select(
        F.col("name").alias("company"),
        "source_type",
        by_case(F.lit("skipped"), F.lit("failed"), good).alias("status"),
        by_case(F.lit(0), F.lit(0), F.col("jobs_fetched")).alias("jobs_fetched"),
        by_case(F.lit("unsupported"), category, good).alias("error_category"),
        by_case(note, message, F.lit("")).alias("error_message"),
    )


def step(previous: DataFrame, outcomes: DataFrame, run_stamp: Column) -> DataFrame:
    """Health after one run; rows of sources outside the run are preserved."""
    last = conform_health(previous).select(
        F.struct(*HEALTH_COLUMNS).alias("last"), F.col("company")
    )
    now = outcomes.select(F.struct(*outcomes.columns).alias("now"), F.col("company"))
    both = now.join(last, "company", "full_outer")
    ran, status = F.col("now").isNotNull(), F.col("now.status")
    failures = F.coalesce("last.consecutive_failures", F.lit(0))
    return both.select(
        "company",
        F.coalesce("now.source_type", "last.source_type").alias("source_type"),
        F.when(ran, run_stamp).otherwise(F.col("last.last_attempt")).alias("last_attempt"),
        F.when(ran & is_ok(status), run_stamp)
        .otherwise(F.coalesce("last.last_success", F.lit("")))
        .alias("last_success"),
        F.when(ran, status).otherwise(F.col("last.status")).alias("status"),
        F.when(ran, F.when(is_ok(status), F.col("now.jobs_fetched")).otherwise(F.lit(0)))
        .otherwise(F.col("last.jobs_fetched"))
        .cast("bigint")
        .alias("jobs_fetched"),
        F.when(ran, F.col("now.error_category")).otherwise(F.col("last.error_category")).alias("error_category"),
        F.when(ran, F.col("now.error_message")).otherwise(F.col("last.error_message")).alias("error_message"),
        F.when(~ran, failures)
        .when(is_ok(status), F.lit(0))
        .when(status == "failed", failures + 1)
        .otherwise(failures)
        .cast("int")
        .alias("consecutive_failures"),
    )


def _moment() -> Column:
    return F.struct("run_ts", "run_id")


@dataclass(frozen=True)
class Partial:
    """What a part of a run log says, in a form that merges with other parts in any order.

    `known` has one row per source: its last run, its last success, the last
    run's result, the number of runs.  `failures(company, moment)` are the failed
    runs after the last success known; a success that turns up later
    takes back those it came after, which a count could not.
    """

    known: DataFrame
    failures: DataFrame

    def write(self, path: str) -> None:
        self.known.write.mode("overwrite").parquet(f"{path}/known")
        self.failures.write.mode("overwrite").parquet(f"{path}/failures")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Partial:
        return Partial(spark.read.parquet(f"{path}/known"), spark.read.parquet(f"{path}/failures"))


def _still_open(failures: DataFrame, known: DataFrame) -> DataFrame:
    """Failures after their source's last success; a hot source is split."""
    looked_up = split_join(failures, known.select("company", "last_ok"), ["company"], "left")
    return looked_up.where("last_ok IS NULL OR moment > last_ok").select("company", "moment")


def partial_fold(run_log: DataFrame) -> Partial:
    ok = is_ok(F.col("status"))
    known = run_log.groupBy("company").agg(
        F.max(_moment()).alias("last_run"),
        F.max(F.when(ok, _moment())).alias("last_ok"),
        F.max_by(F.struct("status", "jobs_fetched"), _moment()).alias("last"),
        F.count(F.lit(1)).alias("runs"),
    )
    failed = run_log.where("status = 'failed'").select("company", _moment().alias("moment"))
    return Partial(known, _still_open(failed, known))


def merge_folds(a: Partial, b: Partial) -> Partial:
    """The partial fold of both parts together."""
    known = a.known.unionByName(b.known).groupBy("company").agg(
        F.max("last_run").alias("last_run"), F.max("last_ok").alias("last_ok"),
        F.max_by("last", "last_run").alias("last"), F.sum("runs").alias("runs"),
    )
    return Partial(known, _still_open(a.failures.unionByName(b.failures), known))


def folded(part: Partial) -> DataFrame:
    """Current health of every source."""
    counts = part.failures.groupBy("company").agg(F.count(F.lit(1)).alias("failures"))
    return part.known.join(counts, "company", "left").select(
        "company",
        F.col("last_run.run_ts").alias("last_attempt"),
        F.col("last_ok.run_ts").alias("last_success"),
        F.col("last.status").alias("status"),
        F.when(is_ok(F.col("last.status")), F.col("last.jobs_fetched")).otherwise(F.lit(0)).cast("bigint").alias("jobs_fetched"),
        F.coalesce("failures", F.lit(0)).cast("bigint").alias("consecutive_failures"),
        "runs",
    )


def fold(run_log: DataFrame) -> DataFrame:
    """Current health of every source from its whole run history.

    Failures count since the last success.  A window per source would put a hot
    source into one task.  Instead the failed rows look up their source's last
    success in a table of one row per source, a join in which adaptive execution
    can split a hot source, and their counts are combined before the shuffle.
    """
    return folded(partial_fold(run_log))


def problems(health: DataFrame) -> DataFrame:
    """Failed sources, then skipped ones; the message is cut for a table cell."""
    return health.where(F.col("status").isin("failed", "skipped")).select(
        F.when(F.col("status") == "failed", F.lit(1)).otherwise(F.lit(2)).alias("status_rank"),
        md_escape(F.col("company")).alias("company"),
        "status",
        "error_category",
        md_escape(truncate(F.col("error_message"), 140)).alias("detail"),
    )
