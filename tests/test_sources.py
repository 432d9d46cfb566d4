"""Normalisers on small landed payloads, problems, and whole runs."""

from __future__ import annotations

import csv
import glob
import json
import os
import re
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.functions.paths import dig_text
from feedloom.operators.identity import first_n_per_key
from feedloom.plans.run import judge_pages, keep_in, plan_run, run_next, run_once, validate_sources
from feedloom.rules import POSTING
from feedloom.schema import DETAIL_SCHEMA, LANDING_SCHEMA, SOURCE_SCHEMA
from feedloom.sources import boards, endpoints, pages
from feedloom.session import shared_folder
from feedloom.sources.landing import REGISTRY, Context, detail_cap, land, normalize, register, source_pages
from feedloom.sources.ledger import Ledger
from feedloom.sources.state import load_envelope, load_health, load_records

STAMP = datetime(2026, 7, 12, 12)


def now():
    return F.lit("2026-07-12 12:00:00").cast("timestamp")


def source(name="Acme", kind="greenhouse", ident="acme", no=1, enabled=True, locations=("New York", "Austin"), notes=""):
    return (no, name, enabled, 2, f"https://{name.lower()}.test/careers", kind, ident, list(locations), notes)


def page(body, name="Acme", kind="greenhouse", preset="", query_no=0, page_no=0, url="https://acme.test/p", context=None):
    text = body if isinstance(body, str) or body is None else json.dumps(body)
    return (name, kind, preset, query_no, page_no, STAMP, url, text, json.dumps(context) if context else None)


def context(spark, sources, details=(), configs=None):
    found = spark.createDataFrame([(n, k, json.dumps(b) if not isinstance(b, str) else b) for n, k, b in details], DETAIL_SCHEMA)
    return Context(spark.createDataFrame(sources, SOURCE_SCHEMA), now(), found if details else None, POSTING, configs or {})


def run(spark, fn, rows, sources, **kw):
    ctx = context(spark, sources, **kw)
    done = fn(source_pages(spark.createDataFrame(rows, LANDING_SCHEMA), ctx.sources), ctx)
    return (
        [r.asDict() for r in done.records.orderBy("fetch_ord").collect()],
        [(r["company"], r["category"]) for r in done.problems.collect()],
    )


BOARD = {"jobs": [
    {"id": 71, "title": "Graduate Backend Engineer (2027)", "updated_at": "2026-07-02T00:00:00Z",
     "first_published": "2026-06-28T09:00:00-04:00", "absolute_url": "https://b.test/71?gh_src=q",
     "location": {"name": "New York, NY"}, "departments": [{"name": "Core"}, {"name": ""}, {"name": "Web"}],
     "content": "&lt;p&gt;Python &amp;amp; SQL.&lt;/p&gt;&lt;p&gt;Visa sponsorship available.&lt;/p&gt;"},
    {"id": 72, "title": "Senior Backend Engineer", "updated_at": "2026-07-02", "absolute_url": "https://b.test/72",
     "location": {"name": "Austin"}, "content": None},
    {"id": 73, "title": "SWE I", "updated_at": "2026-07-03", "absolute_url": "https://b.test/73", "location": None,
     "content": "plain"},
    {"id": 74, "title": "Data Engineer, Entry Level", "updated_at": "2026-07-03", "absolute_url": "https://b.test/74",
     "location": {"name": "Austin, TX"}, "content": "&lt;b&gt;We cannot sponsor visas.&lt;/b&gt;"},
]}


def test_greenhouse(spark):
    rows, problems = run(spark, boards.greenhouse, [page(BOARD)], [source()])
    assert [r["source_job_id"] for r in rows] == ["71", "72", "73", "74"] and problems == []
    first = rows[0]
    assert first["description"] == "Python & SQL. Visa sponsorship available."
    assert (first["department"], first["date_posted"], first["location"]) == ("Core, Web", "2026-06-28", "New York, NY")
    assert (rows[1]["description"], rows[1]["date_posted"], rows[2]["location"]) == ("", "2026-07-02", "")


@pytest.mark.parametrize(
    ("fn", "kind", "body", "ident", "category"),
    [
        (boards.greenhouse, "greenhouse", {"unexpected": []}, "acme", "structure_changed"),
        (boards.greenhouse, "greenhouse", '{"jobs": [', "acme", "parse_error"),
        (boards.greenhouse, "greenhouse", BOARD, " ", "invalid_config"),
        (boards.lever, "lever", {"unexpected": []}, "acme", "structure_changed"),
        (boards.ashby, "ashby", {"x": 1}, "acme", "structure_changed"),
        (boards.workday, "workday", {"total": 0}, "h/t/s", "structure_changed"),
        (boards.workday, "workday", {"jobPostings": []}, "h/t", "invalid_config"),
        (boards.eightfold, "eightfold", {"status": "failure", "errorMsg": "who?"}, "h/d", "structure_changed"),
        (boards.eightfold, "eightfold", {"data": {"positions": []}}, "h", "invalid_config"),
        (endpoints.oracle, "json", {"items": []}, "oracle", "structure_changed"),
        (endpoints.uber, "json", {"data": {}}, "uber", "structure_changed"),
        (endpoints.smartrecruiters, "json", {"content": []}, "smartrecruiters", "invalid_config"),
        (endpoints.generic, "json", {"x": []}, "", "invalid_config"),
        (pages.html_rows, "html", "<p>redesigned</p>", "https://a.test", "invalid_config"),
        (pages.jsonld, "jsonld", "<p>no block</p>", "https://a.test", "parse_error"),
    ],
)
def test_problem_categories(spark, fn, kind, body, ident, category):
    rows, problems = run(spark, fn, [page(body, kind=kind)], [source(kind=kind, ident=ident)])
    assert rows == [] and problems == [("Acme", category)]


def test_empty_list_is_no_problem(spark):
    assert run(spark, boards.greenhouse, [page({"jobs": []})], [source()]) == ([], [])
    assert run(spark, boards.lever, [page([], kind="lever")], [source(kind="lever")]) == ([], [])


def test_lever(spark):
    body = [{"id": "x1", "text": "Data Engineer", "createdAt": 1782000000000, "hostedUrl": "https://l.test/x1",
             "categories": {"location": "Austin, TX", "commitment": "Full-time", "team": "Core"}, "country": "US",
             "workplaceType": "Hybrid", "description": "<p>Hi <b>there</b></p>",
             "lists": [{"text": "REQUIREMENTS", "content": "<li>SQL</li><li>2027 grads</li>"}, {"text": "Perks", "content": "no"}]}]
    (got,), _ = run(spark, boards.lever, [page(body, kind="lever")], [source(kind="lever")])
    assert (got["date_posted"], got["workplace_type"], got["requirements"]) == ("2026-06-21", "hybrid", "SQL 2027 grads")
    assert (got["description"], got["application_url"]) == ("Hi there", "https://l.test/x1")


def test_workday_first_wins_and_details(spark):
    item = lambda path, title, **kw: {"externalPath": path, "title": title, "locationsText": "Austin", "postedOn": "Posted Today", **kw}
    rows = [
        page({"jobPostings": [item("/job/a/R-1", "SWE I"), item("/job/b/R-2", "Manager")]}, kind="workday", query_no=0),
        page({"jobPostings": [item("/job/a/R-1", "later"), item("/job/c/R-3", "SWE I", bulletFields=["JR3"])]}, kind="workday", query_no=1),
    ]
    info = {"jobPostingInfo": {"jobDescription": "<p>D</p>", "timeType": "Full time", "location": "", "country": {"descriptor": "United States of America"},
                               "postedOn": "Posted 30+ Days Ago", "externalUrl": "https://w.test/x"}}
    details = [("Acme", "/job/a/R-1", info), ("Acme", "/job/b/R-2", info)]
    got, _ = run(spark, boards.workday, rows, [source(kind="workday", ident="h.test/t/Site/")], details=details)
    by = {r["source_job_id"]: r for r in got}
    assert set(by) == {"R-1", "R-2", "JR3"}
    assert (by["R-1"]["title"], by["R-1"]["description"], by["R-1"]["date_posted"]) == ("SWE I", "D", "2026-06-12")
    assert (by["R-1"]["country"], by["R-1"]["location"]) == ("United States of America", "Austin")
    assert (by["R-1"]["application_url"], by["R-1"]["source_url"]) == ("https://w.test/x", "https://h.test/en-US/Site/job/a/R-1")
    assert by["R-2"]["description"] == "" and by["JR3"]["date_posted"] == "2026-07-12"


def test_detail_cap_is_per_source(spark):
    items = [{"id": i, "name": "SWE I", "locations": ["Austin"]} for i in range(50)]
    details = [("Acme", str(i), {"data": {"jobDescription": "<p>D</p>"}}) for i in range(50)]
    for configs, expected in (({}, 50), ({"Acme": {"detail_fetch_cap": 40}}, 40)):
        got, _ = run(spark, boards.eightfold, [page({"data": {"positions": items}}, kind="eightfold")],
                     [source(kind="eightfold", ident="h.test/d.test")], details=details, configs=configs)
        assert len(got) == 50 and sum(r["description"] == "D" for r in got) == expected
    assert [r["source_job_id"] for r in got if r["description"]] == [str(i) for i in range(40)]


MAPPING = {"request": {"url": "https://a.test/api"}, "jobs_path": "result.openings",
           "fields": {"source_job_id": "req", "title": "name", "location": "site.city", "description": "desc",
                      "date_posted": "posted", "url": "https://a.test/apply/{source_job_id}"}}


def test_generic_mapping(spark):
    body = {"result": {"openings": [
        {"req": "R-1", "name": "SWE I", "site": {"city": "Denver"}, "posted": "2026-07-01T00:00:00Z", "desc": "<p>SQL</p>"},
        {"req": "R-1", "name": "copy"}, {"name": "no id", "site": [{"city": "A"}, {"city": "B"}]},
    ]}}
    got, problems = run(spark, endpoints.generic, [page(body, kind="json")], [source(kind="json", ident="")], configs={"Acme": MAPPING})
    assert problems == [] and [r["title"] for r in got] == ["SWE I", "no id"]
    assert (got[0]["application_url"], got[0]["date_posted"], got[0]["description"]) == ("https://a.test/apply/R-1", "2026-07-01", "SQL")
    assert got[1]["location"] == "A; B"
    _, problems = run(spark, endpoints.generic, [page({"result": {}}, kind="json")], [source(kind="json", ident="")], configs={"Acme": MAPPING})
    assert problems == [("Acme", "structure_changed")]


def test_jsonld(spark):
    posting = {"@type": ["JobPosting"], "title": "AI Engineer", "datePosted": "2026-07-06T01", "identifier": {"value": 9},
               "jobLocation": [{"address": {"addressLocality": "Boston", "addressRegion": "MA", "addressCountry": {"name": "US"}}},
                               {"address": {"addressLocality": "Boston", "addressRegion": "MA"}}, {"address": "Paris"}],
               "employmentType": [], "description": "<p>RAG</p>", "jobLocationType": "TELECOMMUTE"}
    body = ("<script type='application/ld+json'>oops</script><script type=\"application/ld+json\">"
            + json.dumps({"@graph": [{"deep": {"er": [posting]}}, {"@type": "WebPage"}]}) + "</script>")
    got, problems = run(spark, pages.jsonld, [page(body, kind="jsonld")], [source(kind="jsonld")])
    assert problems == [] and len(got) == 1
    r = got[0]
    assert (r["source_job_id"], r["location"], r["country"]) == ("9", "Boston, MA; Paris", "US")
    assert (r["workplace_type"], r["employment_type"], r["description"], r["application_url"]) == ("remote", "", "RAG", "https://acme.test/p")
    empty = "<script type='application/ld+json'>{\"@type\": \"WebPage\"}</script>"
    assert run(spark, pages.jsonld, [page(empty, kind="jsonld")], [source(kind="jsonld")]) == ([], [])


ROWS = ("<table><tr class='job row'><td class=title><a href='/c/1'>SWE <b>I</b></a></td><td class=location>Austin<br>TX</td></tr>"
        "<tr class='job'><td class=title><a href='/c/1'>dup</a></td></tr><tr class='job'><td>no title</td></tr>"
        "<tr class='job'><td class=title><a href='c/2?x=1'>Other</a></td><td class=when>2026-07-01 09:00</td></tr></table>")
SELECT = {"row_selector": "tr.job", "title_selector": "td.title a", "location_selector": "td.location", "date_selector": ".when"}


def test_html_rows_and_details(spark):
    detail = "<html><body><main>D  text<script>no</script></main></body></html>"
    got, problems = run(spark, pages.html_rows, [page(ROWS, kind="html", url="https://a.test/jobs/list")], [source(kind="html")],
                        configs={"Acme": SELECT}, details=[("Acme", "https://a.test/c/1", detail)])
    assert problems == []
    assert [(r["title"], r["application_url"]) for r in got] == [("SWE I", "https://a.test/c/1"), ("Other", "https://a.test/jobs/c/2?x=1")]
    assert (got[0]["location"], got[1]["date_posted"], got[0]["description"]) == ("Austin TX", "2026-07-01", "D text")
    _, problems = run(spark, pages.html_rows, [page("<p>x</p>", kind="html")], [source(kind="html")], configs={"Acme": SELECT})
    assert problems == [("Acme", "structure_changed")]


def test_rendered_pages(spark):
    rows = [page(ROWS + "<p>Are you a ROBOT</p>", kind="playwright"), page(ROWS, name="Beta", kind="playwright", url="https://b.test/")]
    sources = [source(kind="playwright"), source("Beta", "playwright", no=2)]
    got, problems = run(spark, pages.rendered, rows, sources, configs={"*": SELECT})
    assert problems == [("Acme", "blocked")] and {r["company"] for r in got} == {"Beta"} and len(got) == 3


def test_dispatch_reports_unknown_types_and_landed_errors(spark):
    sources = [source(), source("Beta", "pigeon", no=2), source("Gamma", no=3), source("Off", no=4, enabled=False)]
    rows = [page(BOARD), page("{}", name="Beta", kind="pigeon"), page(BOARD, name="Off"),
            page(None, name="Gamma", context={"error_category": "network_error", "error_message": "refused"})]
    ctx = context(spark, sources)
    found = normalize(spark.createDataFrame(rows, LANDING_SCHEMA), ctx)
    assert sorted((r["company"], r["category"]) for r in found.problems.collect()) == [("Beta", "unsupported"), ("Gamma", "network_error")]
    assert {r["company"] for r in found.accepted().collect()} == {"Acme"}


def test_plug_in(spark):
    @register("pigeon")
    def pigeon(found, ctx):
        return boards.greenhouse(found, ctx)

    try:
        found = normalize(spark.createDataFrame([page(BOARD, kind="pigeon")], LANDING_SCHEMA), context(spark, [source(kind="pigeon")]))
        assert found.records.count() == 4
    finally:
        del REGISTRY[("pigeon", "")]


def test_two_runs_end_to_end(spark, tmp_path):
    sources = spark.createDataFrame(
        [source(), source("Lost", no=2), source("Off", "unresolved", no=3, notes="no public API")], SOURCE_SCHEMA
    )
    payloads = spark.createDataFrame([page(BOARD)], LANDING_SCHEMA)
    folders = [str(tmp_path / n) for n in ("state0", "run1", "run2")]
    delivered = []

    def deliver(digest):
        delivered.append(digest.count())
        return True

    first = run_once(payloads, sources, folders[0], folders[1], now(), deliver=deliver)
    assert "steps" not in os.listdir(folders[1])
    counts = first.summary.first().asDict()
    assert counts == {"companies_checked": 1, "companies_failed": 1, "companies_skipped": 1, "active_jobs": 2,
                      "new_jobs": 2, "closed_jobs": 0, "digest_jobs": 1}
    assert delivered == [1]
    active = {r["title"]: r for r in load_records(spark, f"{folders[1]}/active").collect()}
    good, bad = active["Graduate Backend Engineer (2027)"], active["Data Engineer, Entry Level"]
    assert good["announced"] and not bad["announced"]
    assert (good["sponsorship_classification"], bad["sponsorship_classification"]) == ("likely_supported", "likely_not_supported")
    assert bad["disqualified"] and good["country"] == "United States"

    health = {r["company"]: r for r in load_health(spark, f"{folders[1]}/health").collect()}
    assert (health["Acme"]["status"], health["Acme"]["jobs_fetched"]) == ("ok", 4)
    assert (health["Lost"]["error_category"], health["Lost"]["consecutive_failures"]) == ("network_error", 1)
    assert (health["Off"]["status"], health["Off"]["error_message"]) == ("skipped", "no public API")

    later = F.lit("2026-07-13 12:00:00").cast("timestamp")
    second = run_once(payloads, sources, folders[1], folders[2], later)
    again = {r["title"]: r for r in load_records(spark, f"{folders[2]}/active").collect()}
    assert second.summary.first()["new_jobs"] == 0
    assert all(again[t]["first_seen"] == active[t]["first_seen"] and again[t]["announced"] == active[t]["announced"] for t in active)
    assert load_health(spark, f"{folders[2]}/health").where("company = 'Lost'").first()["consecutive_failures"] == 2

    envelope = spark.read.json(f"{folders[1]}/active/envelope").first()
    assert (envelope["count"], envelope["generated_at"]) == (2, "2026-07-12T12:00:00Z")
    (part,) = [p for p in glob.glob(f"{folders[1]}/active_csv/*.csv")]
    with open(part, encoding="utf-8") as lines:
        cells = {r["title"]: r for r in csv.DictReader(lines)}
    assert "; " in cells["Graduate Backend Engineer (2027)"]["matched_keywords"]


def test_dry_run_writes_nothing(spark, tmp_path):
    sources = spark.createDataFrame([source()], SOURCE_SCHEMA)
    payloads = spark.createDataFrame([page(BOARD)], LANDING_SCHEMA)
    shared = shared_folder(spark)
    before = sorted(os.listdir(shared)), sorted(os.listdir(tmp_path))
    dry = run_once(payloads, sources, str(tmp_path / "none"), str(tmp_path / "out"), now(), dry_run=True)
    assert dry.summary.first()["new_jobs"] == 2 and dry.digest.count() == 1
    # Neither the target nor the session's shared folder got anything.
    assert (sorted(os.listdir(shared)), sorted(os.listdir(tmp_path))) == before
    with pytest.raises(ValueError, match="nobody"):
        run_once(payloads, sources, str(tmp_path / "none"), str(tmp_path / "out"), now(), only=["acme", "Nobody"])


def test_validate_sources(spark):
    sources = spark.createDataFrame([
        source(), source("Beta", no=2), source("Off", no=3, enabled=False, notes="paused"), source("Who", "unresolved", no=4, notes=None),
    ], SOURCE_SCHEMA)
    payloads = spark.createDataFrame([page(BOARD), page({"x": 1}, name="Beta")], LANDING_SCHEMA)
    got = {r["company"]: r for r in validate_sources(payloads, sources, now()).collect()}
    assert (got["Acme"]["result"], got["Acme"]["detail"]) == ("ok (4 jobs)", "Graduate Backend Engineer (2027)")
    assert (got["Beta"]["result"], got["Beta"]["failing"]) == ("FAILED (structure_changed)", 1)
    assert tuple(got["Off"])[1:] == ("disabled", "paused", 0) and tuple(got["Who"])[1:] == ("unresolved", "", 0)


def test_load_envelope_projects_the_schema(spark, tmp_path):
    path = tmp_path / "old.json"
    path.write_text(json.dumps({"count": 1, "jobs": [{"job_id": "a", "title": "T", "gone_field": 1, "matched_keywords": ["x"]}]}))
    (row,) = load_envelope(spark, str(path)).collect()
    assert (row["job_id"], row["status"], row["matched_keywords"], row["announced"]) == ("a", "active", ["x"], False)
    assert load_records(spark, str(tmp_path / "never")).count() == 0


def test_dig_text_joins(one):
    assert one(dig_text(F.try_parse_json(F.col("j")), "a.b"), j='{"a":[{"b":"x"},{"b":"y"},{}]}') == "x; y"
    assert one(dig_text(F.try_parse_json(F.col("j")), None), j="{}") == ""


def test_plan_run_is_lazy(spark):
    ctx = context(spark, [source()])
    empty = load_records(spark, "/nonexistent/feedloom")
    run_ = plan_run(spark.createDataFrame([page(BOARD)], LANDING_SCHEMA), ctx, empty, empty, load_health(spark, "/nonexistent/feedloom"))
    assert run_.merge.new.count() == 2


def test_a_page_without_a_body_is_a_parse_error_not_a_job_failure(spark):
    _, problems = run(spark, pages.html_rows, [page(None, kind="html")], [source(kind="html")], configs={"Acme": SELECT})
    assert problems == [("Acme", "parse_error")]
    _, problems = run(spark, pages.rendered, [page(None, kind="playwright")], [source(kind="playwright")], configs={"Acme": SELECT})
    assert problems == [("Acme", "parse_error")]


def test_a_rendered_posting_without_url_links_to_its_page(spark):
    body = '<script type="application/ld+json">{"@type": "JobPosting", "title": "Dev", "directApply": true}</script>'
    got, _ = run(spark, pages.rendered, [page(body, kind="playwright", url="https://a.test/x")], [source(kind="playwright")], configs={"Acme": SELECT})
    assert [g["application_url"] for g in got] == ["https://a.test/x"]


@pytest.mark.parametrize("selector", ["li#x", "ul > li", "li[id]", "li, p", "li:first-child"])
def test_a_selector_nobody_can_read_is_reported(spark, selector):
    for fn, kind in ((pages.html_rows, "html"), (pages.rendered, "playwright")):
        ctx = context(spark, [source(kind=kind), source("Beta", kind, no=2)], configs={"*": SELECT, "Acme": {"row_selector": selector}})
        rows = spark.createDataFrame([page(ROWS, kind=kind), page(ROWS, name="Beta", kind=kind)], LANDING_SCHEMA)
        done = fn(source_pages(rows, ctx.sources), ctx)
        (problem,) = done.problems.collect()
        assert (problem["company"], problem["category"]) == ("Acme", "invalid_config")
        assert problem["message"].endswith(f"row_selector {selector}")
        assert {r["company"] for r in done.records.collect()} == {"Beta"}


def mixed_landing(spark):
    """Pages of many kinds, two of them by mappings of their own, a broken and a refused one."""
    pairs = [
        ("Green", "greenhouse", "g", BOARD), ("Lever", "lever", "l", [{"id": "x", "text": "SWE I", "hostedUrl": "https://l.test/x"}]),
        ("Amz", "json", "amazon", {"jobs": [{"id": "a1", "title": "SDE I", "job_path": "/p"}]}),
        ("MapA", "json", "", {"result": {"openings": [{"req": "R-1", "name": "SWE I"}]}}),
        ("MapB", "json", "", {"list": [{"n": 7, "t": {"en": "Dev"}, "tags": ["a", "b"]}]}),
        ("Cut", "greenhouse", "g", '{"jobs": ['), ("Refused", "json", "", None), ("Html", "html", "https://a.test", ROWS),
        ("Ld", "jsonld", "x", '<script type="application/ld+json">{"@type": "JobPosting", "title": "Dev"}</script>'),
        ("Odd", "pigeon", "", "{}"),
    ]
    sources = [source(name, kind, ident, no) for no, (name, kind, ident, _) in enumerate(pairs)]
    rows = [
        page(body, name=name, kind=kind, context={"error_category": "blocked", "error_message": "no"} if name == "Refused" else None)
        for name, kind, _, body in pairs
    ]
    configs = {"MapA": MAPPING, "*": SELECT, "MapB": {
        "request": {"url": "https://b.test"}, "jobs_path": "list", "fields": {"title": "t.en", "source_job_id": "n", "department": "tags.1"}}}
    return spark.createDataFrame(rows, LANDING_SCHEMA), sources, configs


def test_mixed_dispatch(spark, tmp_path):
    payloads, sources, configs = mixed_landing(spark)
    ctx = context(spark, sources, configs=configs)
    kept = keep_in(str(tmp_path / "steps"))
    for found in (normalize(payloads, ctx), normalize(payloads, replace(ctx, keep=kept))):
        got = sorted((r["company"], r["source_job_id"], r["title"], r["department"]) for r in found.records.collect() if r["company"] not in ("Green", "Html"))
        assert got == [("Amz", "a1", "SDE I", ""), ("Ld", "", "Dev", None), ("Lever", "x", "SWE I", ""), ("MapA", "R-1", "SWE I", ""), ("MapB", "7", "Dev", "b")]
        assert found.records.where("company IN ('Green', 'Html')").count() == 6
        assert sorted((r["company"], r["category"]) for r in found.problems.collect()) == [
            ("Cut", "parse_error"), ("Odd", "unsupported"), ("Refused", "blocked")]


def test_a_branch_reads_its_partition_and_parses_a_body_once(spark, tmp_path):
    payloads, sources, configs = mixed_landing(spark)
    base = context(spark, sources, configs=configs)
    table = land(payloads, base.sources, str(tmp_path / "landing"))
    plans = {}

    def keep(df, name, by=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep_in(str(tmp_path / "steps"))(df, name, by)

    found = normalize(table, replace(base, keep=keep))
    opened = {n: p for n, p in plans.items() if n.startswith(("opened", "rows", "blocks"))}
    assert sorted(opened) == ["blocks-jsonld", "opened-greenhouse", "opened-json", "opened-json-amazon", "opened-lever", "rows-html"]
    for name, plan in opened.items():
        kind = name.split("-", 1)[1].replace("-", ":")
        (scan,) = [line for line in plan.splitlines() if "FileScan" in line and "body#" in line]
        assert re.search(rf"PartitionFilters: \[isnotnull\(kind#\d+\), \(kind#\d+ = {kind}\)\]", scan)
        assert plan.count("from_json(") <= 1 and "landed" not in plans
    # Records and problems read what was opened; neither goes back to the landing table.
    for df in (found.records, found.problems):
        assert "body#" not in df._jdf.queryExecution().executedPlan().toString()
    assert found.records.count() == 11


def test_no_text_is_shuffled_on_a_sources_name(spark, tmp_path):
    ctx = context(spark, [source(), source("Beta", no=2)])
    plans = {}

    def keep(df, name, by=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep_in(str(tmp_path))(df, name, by)

    judge_pages(spark.createDataFrame([page(BOARD), page({"x": 1}, name="Beta")], LANDING_SCHEMA), replace(ctx, keep=keep))
    # Pages meet the live sources, records the failed ones and the sources' place rules: by broadcasts of written tables.
    for name in ("landed", "judged"):
        assert "BroadcastHashJoin" in plans[name] and "hashpartitioning" not in plans[name], name


def test_a_hundred_mappings_are_one_scan(spark):
    names = [f"S{i}" for i in range(100)]
    configs = {n: {"request": {"url": "u"}, "jobs_path": f"p{i}.rows", "fields": {"title": f"t{i}", "source_job_id": "id"}} for i, n in enumerate(names)}
    ctx = context(spark, [source(n, "json", "", i) for i, n in enumerate(names)], configs=configs)
    rows = [page({f"p{i}": {"rows": [{f"t{i}": f"T{i}", "id": i}]}}, name=n, kind="json") for i, n in enumerate(names)]
    done = endpoints.generic(source_pages(spark.createDataFrame(rows, LANDING_SCHEMA), ctx.sources), ctx)
    assert sorted((r["company"], r["title"]) for r in done.records.collect()) == sorted((n, f"T{i}") for i, n in enumerate(names))
    plan = done.records._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1


def test_a_configured_cap_bounds_rows_before_the_shuffle(spark):
    ctx = context(spark, [source()], configs={"Acme": {"detail_fetch_cap": 2}, "Beta": {"detail_fetch_cap": 5}})
    rows = spark.range(300).select(F.get(F.array(F.lit("Acme"), F.lit("Beta"), F.lit("Free")), (F.col("id") % 3).cast("int")).alias("company"), "id")
    kept = first_n_per_key(rows, ["company"], ["id"], detail_cap(ctx))
    assert {r["company"]: r["count"] for r in kept.groupBy("company").count().collect()} == {"Acme": 2, "Beta": 5, "Free": 100}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1


def test_runs_of_a_ledger(spark, tmp_path):
    sources = spark.createDataFrame([source(), source("Lost", no=2)], SOURCE_SCHEMA)
    payloads = spark.createDataFrame([page(BOARD)], LANDING_SCHEMA)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    first = run_next(payloads, sources, ledger, now())
    assert first.changes.where("lifecycle = 'new'").count() == 2 and first.digest.count() == 1
    second = run_next(payloads.where("FALSE"), sources, ledger, now())
    assert second.changes.count() == 0 and ledger.active(2).count() == 2
    assert {r["company"]: r["consecutive_failures"] for r in second.health.collect()} == {"Acme": 1, "Lost": 2}
    texts = {r["title"]: r["description"] for r in ledger.with_texts(ledger.active(2)).collect()}
    assert texts["Graduate Backend Engineer (2027)"] == "Python & SQL. Visa sponsorship available."
    assert not (tmp_path / "ledger" / "steps" / "2").exists()


def test_detail_cap_is_a_setting_of_the_source(spark):
    from feedloom.operators.enrich import enrich

    names = ["A"] * 3 + ["B"] * 3 + ["C"] * 3
    listing = spark.createDataFrame([(n, str(i), i) for i, n in enumerate(names)], "company STRING, detail_key STRING, fetch_ord INT")
    details = listing.select("company", "detail_key", F.lit("x").alias("body"))

    def attached(configs):
        cap = detail_cap(Context(listing, now(), configs=configs))
        rows = enrich(listing, details, F.lit(True), ["fetch_ord"], "detail_key", cap).where("detail IS NOT NULL")
        return sorted(rows.groupBy("company").count().collect())

    assert attached({}) == [("A", 3), ("B", 3), ("C", 3)]
    assert attached({"A": {"detail_fetch_cap": 1}}) == [("A", 1), ("B", 3), ("C", 3)]
    assert attached({"A": {"detail_fetch_cap": 1}, "*": {"detail_fetch_cap": 2}}) == [("A", 1), ("B", 2), ("C", 2)]
