"""Health, ranking, reports, streams and the oracle at the smallest scale."""

from __future__ import annotations

import importlib.util
import os
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from feedloom.operators import health, rank, report, summary
from feedloom.plans import feeds, streams  # noqa: F401
from feedloom.plans.catalog import QUERIES
from feedloom.plans.oracle import ORACLE
from feedloom.rules import POSTING
from feedloom.schema import SOURCE_SCHEMA, conform_health, conform_records
from feedloom.streaming import runs

LOG = "company STRING, run_ts TIMESTAMP, run_id BIGINT, status STRING, jobs_fetched BIGINT"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def random_log(n, seed=3, hot=0.5):
    rng, start = random.Random(seed), datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        company = "hot" if rng.random() < hot else f"c{rng.randrange(6)}"
        status = rng.choice(["ok", "ok_empty", "failed", "failed", "failed", "skipped"])
        rows.append((company, start + timedelta(minutes=i // 3), i, status, 4 if status == "ok" else 0))
    return rows


def plain_fold(rows):
    out = {}
    for company, ts, run_id, status, n in sorted(rows, key=lambda r: (r[1], r[2])):
        h = out.setdefault(company, {"failures": 0, "success": None, "runs": 0})
        h["runs"] += 1
        h["status"], h["attempt"] = status, ts
        h["jobs"] = n if status == "ok" else 0
        if status in ("ok", "ok_empty"):
            h["failures"], h["success"] = 0, ts
        elif status == "failed":
            h["failures"] += 1
    return out


def shown(df):
    return {
        r["company"]: {"failures": r["consecutive_failures"], "success": r["last_success"], "runs": r["runs"],
                       "status": r["status"], "attempt": r["last_attempt"], "jobs": r["jobs_fetched"]}
        for r in df.collect()
    }


def test_fold_equals_the_plain_loop_with_a_hot_source(spark):
    rows = random_log(600)
    assert shown(health.fold(spark.createDataFrame(rows, LOG))) == plain_fold(rows)


def test_folds_of_parts_merge_in_any_order(spark):
    rows = random_log(300, seed=9)
    shuffled = random.Random(1).sample(rows, len(rows))
    for log in (rows, list(reversed(rows)), shuffled):
        parts = [health.partial_fold(spark.createDataFrame(p, LOG)) for p in (log[:90], log[90:150], log[150:])]
        whole = health.merge_folds(parts[0], health.merge_folds(parts[1], parts[2]))
        assert shown(health.folded(whole)) == plain_fold(rows)


@pytest.mark.parametrize("shuffled", [False, True])
def test_health_stream_over_many_batches(spark, tmp_path, shuffled):
    log = random_log(300, seed=5)
    rows = random.Random(3).sample(log, len(log)) if shuffled else log
    for i in range(3):
        spark.createDataFrame(rows[i * 100:(i + 1) * 100], LOG).coalesce(1).write.parquet(str(tmp_path / f"log{i}"))
    landing = tmp_path / "land"
    landing.mkdir()
    for i in range(3):
        (part,) = (tmp_path / f"log{i}").glob("*.parquet")
        target = landing / f"log-{i}.parquet"
        target.write_bytes(part.read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(landing))
    root = str(tmp_path / "health")
    runs.health_stream(stream, lambda batch: batch, root)
    # The version a repeated micro-batch would read stays; older ones are dropped.
    assert sorted(p.name for p in (tmp_path / "health").iterdir()) == ["version=1", "version=2"]
    assert shown(runs.latest_health(spark, root)) == plain_fold(log)


def test_lifecycle_stream_ages_rows_once_per_batch(spark, tmp_path):
    """Three micro-batches are three runs; a repeated one changes nothing."""
    feed = "company STRING, source_job_id STRING, title STRING, application_url STRING, fetch_ord INT"
    batches = [["1", "2"], ["2"], ["2", "3"]]
    landing = tmp_path / "land"
    landing.mkdir()
    for i, ids in enumerate(batches):
        rows = [("Acme", n, f"T{n}", f"https://a.test/{n}", k) for k, n in enumerate(ids)]
        spark.createDataFrame(rows, feed).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        (part,) = (tmp_path / f"b{i}").glob("*.parquet")
        target = landing / f"b{i}.parquet"
        target.write_bytes(part.read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    empty = conform_records(spark.createDataFrame([], "job_id STRING"))
    ok = spark.createDataFrame([("Acme",)], "company STRING")

    def play(root):
        stream = spark.readStream.schema(feed).option("maxFilesPerTrigger", 1).parquet(str(landing))
        state = runs.lifecycle_stream(
            stream, lambda b: b, empty, empty, lambda b: ok,
            lambda n: F.lit(datetime(2026, 7, 1 + n)).cast("timestamp"), 2, root,
        )
        return {r["job_id"]: (r["lifecycle"], r["consecutive_missing"], r["first_seen"][:10]) for r in state.collect()}

    expected = {"acme-1": ("closed", 2, "2026-07-01"), "acme-2": ("continuing", 0, "2026-07-01"), "acme-3": ("new", 0, "2026-07-03")}
    root = str(tmp_path / "state")
    assert play(root) == expected
    assert play(root) == expected


def test_announce_within_a_bound(spark, sf_dir):
    stream = runs.table_stream(spark, sf_dir, "events").select("ts", F.col("user_id").cast("string").alias("key"))
    out = runs.append_to_table(runs.announce_once(stream, "key", within="60 days"), "bounded")
    assert out.count() == out.select("key").distinct().count() > 0


def test_health_step(spark):
    before = conform_health(spark.createDataFrame(
        [("A", "ok", "t0", 1), ("B", "failed", "", 2), ("Out", "ok", "t0", 0)],
        "company STRING, status STRING, last_success STRING, consecutive_failures INT",
    ))
    now = spark.createDataFrame(
        [("A", "json", "failed", 0, "blocked", "m"), ("B", "json", "ok_empty", 0, "ok_empty", ""), ("C", "json", "skipped", 0, "unsupported", "n")],
        "company STRING, source_type STRING, status STRING, jobs_fetched INT, error_category STRING, error_message STRING",
    )
    got = {r["company"]: r for r in health.step(before, now, F.lit("t1")).collect()}
    assert (got["A"]["consecutive_failures"], got["A"]["last_success"], got["A"]["last_attempt"]) == (2, "t0", "t1")
    assert (got["B"]["consecutive_failures"], got["B"]["last_success"]) == (0, "t1")
    assert (got["C"]["status"], got["C"]["last_success"]) == ("skipped", "")
    assert (got["Out"]["status"], got["Out"]["last_attempt"]) == ("ok", "")


def active(spark):
    rows = [
        ("a", "Zeta", "Data Engineer | I", 70, "2026-07-01", "unclear", "", False),
        ("b", "Alpha", "SWE I", 70, "2026-07-10", "likely_supported", "Visa. " * 60, False),
        ("c", "Beta", "SWE I", 90, "2026-06-01", "likely_supported", "ok", False),
        ("d", "Alpha2", "SWE I", 70, "2026-07-10", "unclear", "", False),
        ("e", "Beta", "SWE I", 95, "", "ineligible", "itar", True),
        ("f", "None", "SWE I", 40, "bad", "unclear", "", False),
    ]
    names = "job_id STRING, company STRING, title STRING, overall_score INT, date_posted STRING, sponsorship_classification STRING, sponsorship_evidence STRING, disqualified BOOLEAN"
    return conform_records(spark.createDataFrame(rows, names).withColumn("application_url", F.lit("https://x.test/1")))


def dims(spark):
    rows = [(i, n, True, p, "", "json", "", [], "") for i, (n, p) in enumerate([("Alpha", 2), ("Alpha2", 1), ("Beta", 3), ("Zeta", 1)])]
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def test_recommended_order(spark):
    visible = active(spark).where("NOT disqualified")
    assert [r["job_id"] for r in rank.sort_recommended(visible, dims(spark)).collect()] == ["c", "d", "b", "a", "f"]


def test_report_lines_and_summary(spark):
    rows = report.report_lines(active(spark), dims(spark), POSTING).collect()
    assert [r["job_id"] for r in rows] == ["c", "d", "b", "a"]
    lines = {r["job_id"]: r for r in rows}
    assert set(lines) == {"a", "b", "c", "d"} and lines["c"]["band"] == "excellent"
    assert lines["a"]["line"].startswith("| [Apply](https://x.test/1) | Zeta | Data Engineer \\| I | ")
    fresh = active(spark).withColumn("lifecycle", F.lit("new"))
    digest = {r["job_id"]: r["line"] for r in report.digest_lines(fresh, dims(spark), POSTING).collect()}
    assert set(digest) == {"a", "b", "c", "d"} and digest["b"].endswith("… |")
    empty = report.new_report_lines(active(spark).where("FALSE"), dims(spark)).collect()
    assert [r["line"] for r in empty] == [report.NO_NEW_ROWS]
    states = conform_health(spark.createDataFrame([("A", "ok"), ("B", "failed"), ("C", "skipped")], "company STRING, status STRING"))
    got = summary.report_summary(active(spark), states, POSTING).first().asDict()
    assert got == {"active_jobs": 6, "recommended": 5, "excellent_jobs": 1, "strong_jobs": 3, "possible_jobs": 0,
                   "low_jobs": 1, "sources_ok": 1, "sources_failed": 1, "sources_skipped": 1}


def test_explorer(spark):
    rows = active(spark)
    new = rows.where("job_id IN ('b', 'e')")
    ids = lambda c, by="score", n=400: [r["job_id"] for r in rank.explore(rows, new, c, POSTING, by, n).collect()]
    assert ids(rank.Explore()) == ["c", "b", "d", "a", "f"]
    assert ids(rank.Explore(show_disqualified=True), n=2) == ["e", "c"]
    assert ids(rank.Explore(new_only=True)) == ["b"]
    assert ids(rank.Explore(query="ALPHA"), "company") == ["b", "d"]
    assert ids(rank.Explore(family="data"), "date") == ["a"]


def test_top_with_rest(spark):
    rows = active(spark)
    got = rank.top_with_rest(rows, rank.explorer_order("score"), 2, F.col("job_id")).collect()
    assert [(r["kind"], r["line"]) for r in got] == [("row", "e"), ("row", "c"), ("rest", "…and 4 more")]


def test_entry_imports_without_a_session():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("entry_module", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.queries()) == set(QUERIES) | set(module.EXTRA_QUERIES)
    # Every catalogue query has SQL; of the optional ones, those that SQL can express.
    assert set(module.oracle_sql()) == set(QUERIES) | set(module.EXTRA_ORACLE)


FAST = ["canonical_urls", "priority_class", "overall_score", "identity_match_tiers", "source_health_fold",
        "normalize_workday", "normalize_mixed", "page_rows", "page_detail_rows", "stream_lifecycle", "stream_announce_bounded"]


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    relation = con.sql(ORACLE[name])
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    ours = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    order = [relation.columns.index(c) for c in columns]
    theirs = sorted(tuple(repr(r[i]) for i in order) for r in relation.fetchall())
    assert ours == theirs
