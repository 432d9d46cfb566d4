"""The run-over-run merge, branch by branch and against a plain loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators import health
from feedloom.operators.identity import first_n_per_key, first_per_key
from feedloom.operators.lifecycle import mark_announced, merge_state, resolve
from feedloom.schema import RECORD_SCHEMA, conform_records
from feedloom.sources.ledger import Ledger, narrow, run_ledger


def now():
    return F.lit("2026-07-12 12:00:00").cast("timestamp")
STAMP = "2026-07-12T12:00:00Z"


def row(n="1", **kw):
    base = {"company": "Acme", "source_job_id": n, "title": "Engineer", "location": "NYC",
            "application_url": f"https://acme.test/jobs/{n}"}
    return {**base, **kw}


def frame(spark, rows, ordered=False):
    if not rows:
        df = spark.createDataFrame([], RECORD_SCHEMA)
        return df.withColumn("fetch_ord", F.lit(0)) if ordered else df
    filled = [{**r, "fetch_ord": i} for i, r in enumerate(rows)]
    names = sorted({k for r in filled for k in r})
    df = spark.createDataFrame([tuple(r.get(k) for k in names) for r in filled], schema=_schema(names))
    return conform_records(df, "fetch_ord") if ordered else conform_records(df)


def _schema(names):
    kinds = {"fetch_ord": "INT", "announced": "BOOLEAN", "consecutive_missing": "INT"}
    return ", ".join(f"{n} {kinds.get(n, 'STRING')}" for n in names)


def merged(spark, fetched, prev=(), arch=(), ok=("Acme",), after=3):
    names = spark.createDataFrame([(c,) for c in ok], "company STRING")
    return merge_state(
        frame(spark, list(fetched), True), frame(spark, list(prev)), frame(spark, list(arch)), names, now(), after
    )


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["job_id"])


def test_new_row(spark):
    (got,) = rows_of(merged(spark, [row()]).state)
    assert (got["lifecycle"], got["first_seen"], got["last_seen"], got["job_id"]) == ("new", STAMP, STAMP, "acme-1")


def test_continuing_keeps_history_and_takes_new_text(spark):
    prev = row(job_id="acme-1", first_seen="2026-01-01T00:00:00Z", announced=True, consecutive_missing=2)
    (got,) = rows_of(merged(spark, [row(description="rewritten", location="NYC  ")], [prev]).state)
    assert (got["lifecycle"], got["first_seen"], got["announced"]) == ("continuing", "2026-01-01T00:00:00Z", True)
    assert (got["description"], got["consecutive_missing"], got["last_seen"]) == ("rewritten", 0, STAMP)


def test_duplicates_collapse_to_the_first(spark):
    (got,) = rows_of(merged(spark, [row(title="first"), row(title="second")]).state)
    assert got["title"] == "first"


def test_equal_urls_of_two_new_rows_do_not_collapse(spark):
    url = "https://acme.test/same"
    got = merged(spark, [row("1", application_url=url), row("2", application_url=url)]).new
    assert got.count() == 2


def test_url_match_when_the_id_changed(spark):
    prev = row("old", job_id="acme-old", application_url="https://acme.test/jobs/1?utm_source=x")
    (got,) = rows_of(merged(spark, [row("9", application_url="https://acme.test/jobs/1")], [prev]).state)
    assert (got["job_id"], got["lifecycle"], got["matched_by"]) == ("acme-old", "continuing", "active/url")


def test_blank_urls_never_match(spark):
    prev = row("a", job_id="acme-a", title="X", application_url="")
    got = rows_of(merged(spark, [row("b", title="Y", application_url="")], [prev]).state)
    assert [r["lifecycle"] for r in got] == ["missing", "new"]


def test_fingerprint_match(spark):
    prev = row("a", job_id="acme-a", application_url="")
    (got,) = rows_of(merged(spark, [row("b", application_url="", title=" ENGINEER ")], [prev]).state)
    assert got["matched_by"] == "active/fingerprint"


def test_missing_then_closed(spark):
    prev = [row(job_id="acme-1")]
    for count in (1, 2):
        (got,) = rows_of(merged(spark, [], prev).state)
        assert (got["lifecycle"], got["consecutive_missing"], got["status"]) == ("missing", count, "active")
        prev = [{k: v for k, v in got.items() if isinstance(v, (str, bool, int)) and k not in ("lifecycle", "matched_by", "disqualified", "role_match_score", "overall_score")}]
    result = merged(spark, [], prev)
    (got,) = rows_of(result.closed)
    assert (got["status"], got["consecutive_missing"]) == ("closed", 3)
    assert result.active.count() == 0 and result.archived.count() == 1


def test_failed_source_is_carried(spark):
    (got,) = rows_of(merged(spark, [], [row(job_id="acme-1", consecutive_missing=2)], ok=("Other",)).state)
    assert (got["lifecycle"], got["consecutive_missing"]) == ("carried", 2)


def test_reopened(spark):
    old = row(job_id="acme-1", first_seen="2026-01-01T00:00:00Z", announced=True, status="closed")
    result = merged(spark, [row()], arch=[old])
    (got,) = rows_of(result.state)
    assert (got["lifecycle"], got["first_seen"], got["announced"], got["status"]) == (
        "reopened", "2026-01-01T00:00:00Z", True, "active",
    )
    assert result.archived.count() == 0 and result.new.count() == 0


def test_mark_announced(spark):
    active = frame(spark, [row(job_id="a"), row(job_id="b")])
    got = rows_of(mark_announced(active, active.where("job_id = 'a'")))
    assert [r["announced"] for r in got] == [True, False]


# A plain in-memory statement of the rules, to compare random histories with.
def plain_merge(fetched, prev, arch, ok, after):
    def index(rows):
        ids, urls, prints = {}, {}, {}
        for r in sorted(rows, key=lambda r: (r["company"].lower(), r["job_id"])):
            ids.setdefault(r["job_id"], r)
            if r["application_url"]:
                urls.setdefault((r["company"], r["application_url"].split("?")[0]), r)
            prints.setdefault((r["company"], r["title"], r["application_url"]), r)
        return ids, urls, prints

    def look(tables, r, job_id):
        url = r["application_url"].split("?")[0]
        return (tables[0].get(job_id) or (tables[1].get((r["company"], url)) if url else None)
                or tables[2].get((r["company"], r["title"], r["application_url"])))

    live, shelf, seen, out, revived = index(prev), index(arch), set(), {}, set()
    for r in fetched:
        own = f"{r['company'].lower()}-{r['source_job_id']}"
        hit, again = look(live, r, own), None
        if hit is None:
            again = look(shelf, r, own)
        job_id = (hit or again or {"job_id": own})["job_id"]
        if job_id in seen:
            continue
        seen.add(job_id)
        if again:
            revived.add(job_id)
        out[job_id] = "continuing" if hit else "reopened" if again else "new"
    result = [(j, k) for j, k in out.items()]
    for p in prev:
        if p["job_id"] in seen:
            continue
        if p["company"] not in ok:
            result.append((p["job_id"], "carried"))
        else:
            result.append((p["job_id"], "closed" if p["consecutive_missing"] + 1 >= after else "missing"))
    result += [(a["job_id"], "archived") for a in arch if a["job_id"] not in revived]
    return sorted(result)


def test_random_histories_equal_the_plain_rules(spark):
    rng = random.Random(7)
    for _ in range(3):
        def make(i, known):
            company = rng.choice(["Acme", "Acme", "Acme", "Beta", "Gone"])
            made = {
                "company": company, "source_job_id": str(i), "title": rng.choice(["A", "B", "C"]), "location": "",
                "application_url": rng.choice(["", f"https://x.test/{rng.randrange(60)}", f"https://x.test/{rng.randrange(60)}?utm_source=q"]),
            }
            if known:
                made |= {"job_id": f"{company.lower()}-{i}", "consecutive_missing": rng.randrange(3)}
            return made

        ids = list(range(120))
        rng.shuffle(ids)
        prev, arch = [make(i, True) for i in ids[:50]], [make(i, True) for i in ids[50:80]]
        fetched = [make(rng.choice(ids), False) for _ in range(150)]
        fetched = [r for r in fetched if r["company"] != "Gone"]
        got = merged(spark, fetched, prev, arch, ok=("Acme", "Beta")).state
        pairs = sorted((r["job_id"], r["lifecycle"]) for r in got.select("job_id", "lifecycle").collect())
        assert pairs == plain_merge(fetched, prev, arch, {"Acme", "Beta"}, 3)


def test_refetching_the_same_snapshot_changes_nothing(spark):
    rows = [row(str(i)) for i in range(20)]
    first = merged(spark, rows).state.drop("lifecycle", "matched_by")
    again = merge_state(
        frame(spark, rows, True), first, spark.createDataFrame([], RECORD_SCHEMA),
        spark.createDataFrame([("Acme",)], "company STRING"), now(),
    )
    assert {r["lifecycle"] for r in again.state.select("lifecycle").distinct().collect()} == {"continuing"}
    assert again.state.count() == 20


def test_merge_joins_on_keys_only(spark):
    plan = merged(spark, [row()], [row(job_id="a")]).state._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


HOT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def hot(spark):
    """Small thresholds, under which a hot key of a small table is split as one of a large table would be."""
    before = {k: spark.conf.get(k, None) for k in HOT}
    for k, v in HOT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_url_of_a_third_of_all_rows_is_looked_up_in_many_tasks(hot):
    n = 30_000
    url = F.when(F.col("id") % 3 == 0, F.lit("https://acme.test/all")).otherwise(F.concat(F.lit("https://acme.test/"), "id"))
    rows = hot.range(n).select(
        F.col("id").alias("fetch_ord"), F.lit("Acme").alias("company"), F.md5(F.col("id").cast("string")).alias("source_job_id"),
        F.col("id").cast("string").alias("title"), url.alias("application_url"),
    )
    fresh = conform_records(rows, "fetch_ord").withColumn("job_id", F.concat(F.lit("new-"), "source_job_id"))
    old = conform_records(rows.where("fetch_ord % 2 = 0").withColumn("job_id", F.concat(F.lit("old-"), "source_job_id")))
    found = resolve(fresh, old, old.where("FALSE"))
    assert "skew=true" in final_plan(found)
    # The first state row in order that has the shared address answers for all.
    ranks = {r["rank"]: r["count"] for r in found.groupBy("rank").count().collect()}
    assert ranks == {2: n // 3 + n // 3, None: n // 3}


def test_failures_of_a_hot_source_are_looked_up_in_many_tasks(hot):
    company = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 5_000))
    log = hot.range(60_000).select(company.alias("company"), F.col("id").alias("run_ts"), F.col("id").alias("run_id"),
                                   F.lit("failed").alias("status"), F.lit(0).alias("jobs_fetched"))
    part = health.partial_fold(log)
    assert "skew=true" in final_plan(part.failures)
    assert part.failures.where("company = 'hot'").count() == 20_000


def test_a_merge_is_a_plan_and_runs_nothing(spark):
    tracker = spark.sparkContext.statusTracker()
    rows, old = frame(spark, [row()], True), frame(spark, [row(job_id="a")])
    spark.sparkContext.setJobGroup("merge", "merge")
    named = []

    def keep(df, name):
        named.append(name)
        return df

    merge_state(rows, old, old.where("FALSE"), old.select("company"), now(), keep=keep)
    assert list(tracker.getJobIdsForGroup("merge")) == [] and named == ["winners", "ok-sources"]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# ----------------------------------------------------------------- ledger
def ledger_rows(spark, rows):
    return frame(spark, rows, True)


def play_ledger(spark, root, batches, every):
    ledger = Ledger(spark, str(root), every)
    ledger.start()
    ok = spark.createDataFrame([("Acme",)], "company STRING")
    for n, rows in enumerate(batches, 1):
        def keep(df, name, n=n):
            df.write.mode("overwrite").parquet(f"{root}-steps/{n}/{name}")
            return spark.read.schema(df.schema).parquet(f"{root}-steps/{n}/{name}")

        run_ledger(ledger, n, ledger_rows(spark, rows), ok, now(), 2, keep)
    return ledger


BATCHES = [
    [row("1", description="a"), row("2", description="b"), row("1", description="copy")],
    [row("2", description="b"), row("3", description="c", requirements="r")],
    [row("2", description="edited"), row("3", description="c", requirements="r")],
    [row("1", description="back")],
    [],
]


def test_a_ledger_equals_the_runs_and_writes_what_changed(spark, tmp_path):
    """New, continuing, edited, missing, closed and reopened rows over five runs and two bases."""
    ledger = play_ledger(spark, tmp_path / "ledger", BATCHES, 2)
    assert ledger.newest() == 5
    got = {r["job_id"]: r for r in ledger.with_texts(ledger.state(5)).collect()}
    shown = {j: (r["lifecycle"], r["consecutive_missing"], r["status"], r["description"], r["requirements"]) for j, r in got.items()}
    # The second run missed 1 once, the third twice, which closes it; the fourth has it again.
    assert shown == {
        "acme-1": ("missing", 1, "active", "back", ""), "acme-2": ("closed", 2, "closed", "edited", ""),
        "acme-3": ("closed", 2, "closed", "c", "r"),
    }
    assert sorted(r["job_id"] for r in ledger.active(5).collect()) == ["acme-1"]
    folders = lambda kind: sorted(p.name for p in (tmp_path / "ledger" / kind).iterdir())
    rows = lambda kind, n: sorted(r["job_id"] for r in spark.read.parquet(f"{ledger.root}/{kind}/version={n}").collect())
    # Texts are those of new, edited and reopened rows; closed rows are not written again.
    assert [rows("texts", n) for n in range(1, 6)] == [["acme-1", "acme-2"], ["acme-3"], ["acme-2"], ["acme-1"], []]
    assert folders("changes") == ["version=3", "version=4", "version=5"] and folders("base") == ["version=2", "version=4"]
    assert [rows("changes", n) for n in (3, 4, 5)] == [["acme-1", "acme-2", "acme-3"], ["acme-1", "acme-2", "acme-3"], ["acme-1", "acme-2", "acme-3"]]


def test_no_text_crosses_the_merge(spark, tmp_path):
    ledger = play_ledger(spark, tmp_path / "ledger", BATCHES[:1], 10)
    rows = narrow(ledger_rows(spark, BATCHES[1]), "fetch_ord")
    merge = ledger.merge(2, rows, spark.createDataFrame([("Acme",)], "company STRING"), now(), 2)
    plan = merge.state._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "texts" in line]
    assert scans == []
    for c in ("description", "requirements"):
        assert c not in rows.columns


def test_first_per_key_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("k"), "id", F.lit("c").alias("company"))
    once = first_per_key(df, ["company", "k"], ["id"])
    assert sorted(r["id"] for r in once.collect()) == [0, 1, 2]
    assert "WindowGroupLimit" in once._jdf.queryExecution().executedPlan().toString()
    capped = first_n_per_key(df, ["company"], ["id"], 40)
    assert capped.count() == 40
    blank = spark.createDataFrame([("", 1), (None, 2), ("x", 3)], "k STRING, id INT")
    assert [r["id"] for r in first_per_key(blank, ["k"], ["id"]).collect()] == [3]
