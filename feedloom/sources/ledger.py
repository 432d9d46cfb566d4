"""State that is appended to: a base, the changes since, and texts on the side.

A saved snapshot costs a full rewrite per run.  A ledger is a folder of tables that grow with what changes:

    base/version=N      narrow rows of the whole state after run N (every `every` runs)
    changes/version=N   narrow rows that run N added or changed, one per job_id
    texts/version=N     (job_id, description, requirements) of rows that are new in run N, or whose text is

State rows hold `text_id`, a hash of their texts, `text_version`, the run that wrote these, and `changed_in`, the run that wrote
the row: what a row's `lifecycle` says holds for that run, and one that later runs left alone reads as carried or archived.
The merge sees narrow rows only; texts are picked for the rows that need them, by their fetch order, and joined back only for
outputs that show them.

Runs are numbered from 1; version 0 is the state a ledger starts with.  Run N reads version N-1 and writes folders of its own
number, so a run that failed, or a repeated micro-batch, is simply run again.  Which base a version builds on follows from
the number alone; nothing is listed or counted to find it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import split_join
from ..operators.lifecycle import KEPT_ACTIVE, Keep, Merge, merge_state, unkept
from ..schema import RECORD_COLUMNS, RECORD_SCHEMA, conform_records
from ..session import exists, remove

TEXTS = ("description", "requirements")
NARROW = [c for c in RECORD_COLUMNS if c not in TEXTS]
CARRY = ("text_id", "text_version")
UNCHANGED = ("carried", "archived")
COLUMNS = [*NARROW, "lifecycle", "matched_by", *CARRY, "changed_in"]


def text_id() -> Column:
    """Tells edited texts; 128 bits, so that two texts of one posting do not meet by chance."""
    both = F.concat_ws("\0", *TEXTS)
    return F.md5(both)


def narrow(rows: DataFrame, *extra: str) -> DataFrame:
    """Rows without their texts, which `text_id` stands for."""
    return rows.select(*[c for c in NARROW if c in rows.columns], text_id().alias("text_id"), *extra)


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    root: str
    #: Runs between two bases.
    every: int = 10

    def _path(self, kind: str, version: int) -> str:
        return f"{self.root}/{kind}/version={version}"

    def _read(self, kind: str, versions: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{kind}").parquet(*[self._path(kind, v) for v in versions])

    def base_of(self, version: int) -> int:
        return version - version % self.every

    # ------------------------------------------------------------------ reading
    def state(self, version: int) -> DataFrame:
        """Narrow rows after a run: the base without what changed since, and the last change of each id."""
        rows = self._rows(self.base_of(version), version)
        now, shelved = F.col("changed_in") == version, F.col("lifecycle").isin("closed", "archived")
        return rows.withColumns({
            "lifecycle": F.when(now, F.col("lifecycle")).when(shelved, F.lit("archived")).otherwise(F.lit("carried")),
            "matched_by": F.when(now, F.col("matched_by")).otherwise(F.lit("none")),
        })

    def _rows(self, base: int, version: int) -> DataFrame:
        """The rows of a base, and the changes after it in place of theirs."""
        rows = self._read("base", [base]).select(COLUMNS)
        if version == base:
            return rows
        changes = self._read("changes", list(range(base + 1, version + 1)))
        last = changes.groupBy("job_id").agg(F.max_by(F.struct(*COLUMNS), "changed_in").alias("row")).select("row.*")
        return rows.join(last.select("job_id"), "job_id", "left_anti").unionByName(last)

    def active(self, version: int) -> DataFrame:
        return self.state(version).where(F.col("lifecycle").isin(*KEPT_ACTIVE))

    def archived(self, version: int) -> DataFrame:
        return self.state(version).where(~F.col("lifecycle").isin(*KEPT_ACTIVE))

    def with_texts(self, rows: DataFrame) -> DataFrame:
        """State rows with their texts, as records; only the versions the rows name are joined."""
        texts = self.spark.read.schema(f"job_id STRING, {', '.join(f'{t} STRING' for t in TEXTS)}, version INT").parquet(f"{self.root}/texts")
        found = rows.join(texts.withColumnRenamed("version", "text_version"), ["job_id", "text_version"], "left")
        return found.select(*[F.coalesce(c, F.lit("")).alias(c) if c in TEXTS else F.col(c) for c in [*RECORD_COLUMNS, "lifecycle", "matched_by"]])

    def newest(self) -> int:
        """The last version written."""
        if not exists(self.spark, f"{self.root}/changes"):
            return 0
        return self.spark.read.parquet(f"{self.root}/changes").agg(F.max("version")).first()[0] or 0

    # ------------------------------------------------------------------ writing
    def start(self, active: DataFrame | None = None, archived: DataFrame | None = None) -> None:
        """Version 0: an earlier snapshot, or nothing.  A ledger that has begun is left alone."""
        if exists(self.spark, f"{self.root}/base"):
            return
        none = self.spark.createDataFrame([], RECORD_SCHEMA)
        rows = conform_records(active if active is not None else none).withColumn("lifecycle", F.lit("carried")).unionByName(
            conform_records(archived if archived is not None else none).withColumn("lifecycle", F.lit("archived"))
        ).withColumns({"matched_by": F.lit("none"), "text_id": text_id(), "text_version": F.lit(0), "changed_in": F.lit(0)})
        rows.select("job_id", *TEXTS).write.mode("overwrite").parquet(self._path("texts", 0))
        rows.select(COLUMNS).write.mode("overwrite").parquet(self._path("base", 0))

    def merge(self, version: int, fetched: DataFrame, ok_companies: DataFrame, run_ts: Column, archive_after: int,
              keep: Keep = unkept) -> Merge:
        """Run `version` as a plan: narrow fetched rows (with `fetch_ord` and `text_id`) against the state before."""
        rows = fetched.withColumn("text_version", F.lit(version))
        return merge_state(
            rows, self.active(version - 1), self.archived(version - 1), ok_companies, run_ts, archive_after, keep, CARRY
        )

    def append(self, version: int, merge: Merge, fetched: DataFrame) -> DataFrame:
        """Write what a run changed; `fetched` holds the texts by `fetch_ord`.  Returns the changes with `fetch_ord`.

        Texts are written before a reader can ask for them: a version counts once the next run, or a base, builds on it.
        """
        changed = merge.state.where(~F.col("lifecycle").isin(*UNCHANGED))
        same = F.col("was_text_id").isNotNull() & (F.col("was_text_id") == F.col("text_id"))
        # A row that was not fetched keeps its text; it has no fetch order.
        own = F.when(same | F.col("fetch_ord").isNull(), F.col("was_text_version")).otherwise(F.lit(version))
        rows = changed.withColumns({"text_version": F.coalesce(own, F.lit(version)).cast("int"), "changed_in": F.lit(version)})
        path = self._path("changes", version)
        written = rows.select(*COLUMNS, "fetch_ord")
        written.write.mode("overwrite").parquet(path)
        saved = self.spark.read.schema(written.schema).parquet(path)
        needed = saved.where((F.col("text_version") == version) & F.col("fetch_ord").isNotNull()).select("job_id", "fetch_ord")
        texts = split_join(fetched.select("fetch_ord", *TEXTS), needed, ["fetch_ord"])
        texts.select("job_id", *TEXTS).write.mode("overwrite").parquet(self._path("texts", version))
        if version % self.every == 0:
            self.compact(version)
        return saved

    def compact(self, version: int) -> None:
        """Write a base for a version that has none yet, and drop what only older versions need.

        The base before stays, so that the run can be repeated; texts stay, since long-lived rows name old versions.
        """
        before = version - self.every
        rows = self._rows(before, version)
        rows.write.mode("overwrite").parquet(self._path("base", version))
        for old in range(max(0, before - self.every), before):
            remove(self.spark, self._path("changes", old + 1))
        if before - self.every >= 0:
            remove(self.spark, self._path("base", before - self.every))


def run_ledger(ledger: Ledger, version: int, fetched: DataFrame, ok_companies: DataFrame, run_ts: Column, archive_after: int,
               keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """One run: judged rows (kept by the caller, as they are read twice) are merged without texts and appended.

    Returns the changes.
    """
    judged = conform_records(fetched, "fetch_ord")
    merge = ledger.merge(version, narrow(judged, "fetch_ord"), ok_companies, run_ts, archive_after, keep)
    return ledger.append(version, merge, judged)
