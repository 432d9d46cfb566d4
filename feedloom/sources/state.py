"""State snapshots and outputs.  Every write is a distributed Spark write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.dates import utc_stamp
from ..operators.gates import digest_eligible
from ..operators.lifecycle import Merge, mark_announced
from ..operators.rank import sort_recommended
from ..rules import RulePack
from ..schema import (
    HEALTH_COLUMNS, HEALTH_SCHEMA, RECORD_COLUMNS, RECORD_SCHEMA, conform_health, conform_records,
)

FORMATS = ("parquet", "json", "orc")


def _load(spark: SparkSession, path: str, schema, fmt: str) -> DataFrame:
    try:
        return spark.read.schema(schema).format(fmt).load(f"{path}/rows")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def load_records(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A saved dataset; empty when it was never written.

    Unknown columns are dropped, missing ones take their default.
    """
    return conform_records(_load(spark, path, RECORD_SCHEMA, fmt))


def load_health(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return conform_health(_load(spark, path, HEALTH_SCHEMA, fmt))


def load_envelope(spark: SparkSession, path: str, list_field: str = "jobs") -> DataFrame:
    """Read the single-document form {"generated_at", "count", "jobs": [...]}."""
    schema = HEALTH_SCHEMA if list_field == "sources" else RECORD_SCHEMA
    whole = spark.read.option("multiLine", True).schema(
        f"{list_field} ARRAY<{schema.simpleString()}>"
    ).json(path)
    rows = whole.select(F.inline(list_field))
    return conform_health(rows) if list_field == "sources" else conform_records(rows)


def _save(rows: DataFrame, path: str, run_ts: Column, fmt: str) -> None:
    rows.write.mode("overwrite").format(fmt).save(f"{path}/rows")
    # The count comes from what was written, so the rows are not computed twice.
    written = rows.sparkSession.read.schema(rows.schema).format(fmt).load(f"{path}/rows")
    written.agg(F.count(F.lit(1)).alias("count")).select(
        utc_stamp(run_ts).alias("generated_at"), "count"
    ).write.mode("overwrite").json(f"{path}/envelope")


def save_records(df: DataFrame, path: str, run_ts: Column, fmt: str = "parquet") -> None:
    """Rows plus a one-row envelope (`generated_at`, `count`)."""
    _save(df.select(*RECORD_COLUMNS), path, run_ts, fmt)


def csv_rows(df: DataFrame) -> DataFrame:
    """Fixed column order, arrays joined by '; '."""
    arrays = {f.name for f in RECORD_SCHEMA if f.dataType.typeName() == "array"}
    return df.select(
        *[F.array_join(c, "; ").alias(c) if c in arrays else F.col(c) for c in RECORD_COLUMNS]
    )


def save_csv(df: DataFrame, path: str) -> None:
    # Quote doubling keeps line breaks and quotes inside a cell readable anywhere.
    csv_rows(df).write.mode("overwrite").options(header=True, escape='"').csv(path)


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of `save_csv`, every cell a text; CSV has no NULL, and a cell may hold line breaks."""
    schema = ", ".join(f"{c} STRING" for c in RECORD_COLUMNS)
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True).csv(path).na.fill("")


def save_health(df: DataFrame, path: str, run_ts: Column, fmt: str = "parquet") -> None:
    _save(df.select(*HEALTH_COLUMNS).orderBy(F.lower("company")), path, run_ts, fmt)


def state_sorted(df: DataFrame) -> DataFrame:
    return df.orderBy(F.lower("company"), "job_id")


def write_outputs(
    merge: Merge, health: DataFrame, sources: DataFrame, folder: str, run_ts: Column,
    pack: RulePack, deliver: Callable[[DataFrame], bool] | None = None,
) -> tuple[Merge, DataFrame]:
    """All outputs of a run; returns the merge and the health as they were written.

    The merge is computed and written once, partitioned by `lifecycle`; the
    other outputs read that table back, pruned to their partitions.  `deliver`
    gets the digest; only when it reports success are its rows saved as
    announced, so a failed delivery leaves the flags alone.
    """
    spark = health.sparkSession
    merge.state.write.mode("overwrite").partitionBy("lifecycle").parquet(f"{folder}/state")
    saved = Merge(spark.read.schema(merge.state.schema).parquet(f"{folder}/state"))
    digest = digest_eligible(saved.state, pack)
    active = saved.active
    if deliver is not None and deliver(digest):
        active = mark_announced(active, digest)
    save_records(state_sorted(active), f"{folder}/active", run_ts)
    save_csv(state_sorted(load_records(spark, f"{folder}/active")), f"{folder}/active_csv")
    save_records(sort_recommended(saved.new, sources), f"{folder}/new", run_ts)
    save_records(state_sorted(saved.archived), f"{folder}/archived", run_ts)
    save_health(health, f"{folder}/health", run_ts)
    return saved, load_health(spark, f"{folder}/health")
