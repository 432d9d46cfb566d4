"""Catalogue queries that run as streams; their oracle is the batch answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import runs
from . import catalog, views
from .catalog import PACK, query
from .views import FETCH_TS, PARTS, REMEMBERED, run_ts


@query
def stream_lifecycle(spark, folder):
    root = scratch_path(spark, "lifecycle")
    known, ok = views.history(spark, folder, texts=True), views.ok_sources(spark, folder)
    state = runs.lifecycle_stream(
        runs.table_stream(spark, folder, "documents"),
        lambda batch: views.fetched(batch.sparkSession, folder, batch, ok=ok),
        views.previous_state(spark, folder, known), views.archived_state(spark, folder, known),
        lambda batch: ok, lambda batch_id: run_ts(FETCH_TS), PACK.archive_after_missing_runs, root,
    )
    return state.select(*catalog._STATE)


@query
def stream_health(spark, folder):
    root = scratch_path(spark, "health")
    runs.health_stream(
        runs.table_stream(spark, folder, "events"),
        lambda batch: views.run_log(batch.sparkSession, folder, batch), root,
    )
    return catalog.shown_health(runs.latest_health(spark, root))


def in_turns(spark: SparkSession, parts: list[DataFrame], play: Callable[[DataFrame], object]) -> object:
    """Land one part after the other in a folder and run the stream over it after each; the last run's result.

    Every run goes on from the checkpoint of the one before, as scheduled runs do; a part is a micro-batch.
    """
    landing = scratch_path(spark, "landing")
    result = None
    for part in parts:
        part.write.mode("append").parquet(landing)
        result = play(spark.readStream.schema(part.schema).parquet(landing))
    return result


@query
def stream_lifecycle_runs(spark, folder):
    """Three runs of a ledger, each over a third of the documents: rows go missing, close and reopen."""
    root, docs = scratch_path(spark, "lifecycle"), views.table(spark, folder, "documents")
    known, ok = views.history(spark, folder, texts=True), views.ok_sources(spark, folder)
    state = in_turns(
        spark, [docs.where(F.col("doc_id") % 3 == n) for n in range(3)],
        lambda stream: runs.lifecycle_stream(
            stream, lambda batch: views.fetched(batch.sparkSession, folder, batch, ok=ok),
            views.previous_state(spark, folder, known), views.archived_state(spark, folder, known),
            lambda batch: ok, lambda batch_id: run_ts(FETCH_TS), PACK.archive_after_missing_runs, root, every=2,
        ),
    )
    return state.select(*catalog._STATE)


@query
def stream_health_shuffled(spark, folder):
    """Micro-batches in no order of time give the batch answer."""
    root, events = scratch_path(spark, "health"), views.table(spark, folder, "events")
    in_turns(
        spark, [events.where(F.col("event_id") % 3 == n) for n in (2, 0, 1)],
        lambda stream: runs.health_stream(stream, lambda batch: views.run_log(batch.sparkSession, folder, batch), root),
    )
    return catalog.shown_health(runs.latest_health(spark, root))


@query
def stream_announce_bounded(spark, folder):
    """Sources announced once within a bound: keys expire between runs and come again; late rows are dropped."""
    at = F.date_trunc("second", "ts")
    log = views.run_log(spark, folder).select("company", F.col("run_ts").alias("ts"))
    first, second = (F.lit(p).cast("timestamp") for p in PARTS)
    part = F.when(F.col("ts") < first, F.lit(0)).when(F.col("ts") < second, F.lit(1)).otherwise(F.lit(2))
    newest = log.groupBy("company", part.alias("part")).agg(F.max(at).alias("ts"))
    # Some sources of the last part report what was due in the first one.
    due = F.when((F.col("part") == 2) & F.endswith("company", F.lit("0")), first - F.expr("INTERVAL 1 DAY"))
    rows = newest.withColumn("ts", F.coalesce(due, F.col("ts")))
    out = scratch_path(spark, "bounded")

    def play(stream: DataFrame) -> DataFrame:
        return runs.append_to_table(runs.announce_once(stream, "company", REMEMBERED), "bounded", out)

    return in_turns(spark, [rows.where(F.col("part") == n).select("company", "ts") for n in range(3)], play).select(
        "company", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("announced_at")
    )


@query
def stream_announce_once(spark, folder):
    rows = views.run_log(spark, folder, runs.table_stream(spark, folder, "events")).select("company")
    return runs.append_to_table(runs.announce_once(rows, "company"), "announced")


@query
def stream_date_floor(spark, folder):
    orders = runs.table_stream(spark, folder, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted")
    )
    return runs.append_to_table(runs.date_floor(orders, "posted", PACK.min_posted_date), "floor")
