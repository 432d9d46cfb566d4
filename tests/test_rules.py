"""Gates, classifiers and scoring with the posting pack."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feedloom.operators import classify, gates, score
from feedloom.operators.refine import batch_refiner, refine
from feedloom.plans.run import judge_records
from feedloom.rules import POSTING, RulePack
from feedloom.schema import SOURCE_SCHEMA, conform_records

def now():
    return F.lit("2026-07-12 00:00:00").cast("timestamp")
ALLOWED = ["United States", "New York", "Remote - US", "Austin"]


def sources(spark, allowed=ALLOWED):
    row = (1, "Acme", True, 2, "https://acme.test", "greenhouse", "acme", allowed, "")
    return spark.createDataFrame([row], SOURCE_SCHEMA)


def judge(spark, rows, pack=POSTING, refiner=None):
    df = spark.createDataFrame([{"company": "Acme", "fetch_ord": i, **r} for i, r in enumerate(rows)])
    done = judge_records(df, sources(spark), pack, now(), refiner)
    return [r.asDict() for r in done.orderBy("fetch_ord").collect()]


@pytest.mark.parametrize(
    "title",
    [
        "Software Engineer - New Grad 2027", "Graduate Backend Engineer", "ML Engineer (Early Career)",
        "Associate Engineer", "SWE I", "Entry-Level Data Engineer", "Fullstack 2026",
    ],
)
def test_titles_that_pass(one, title):
    assert one(gates.title_prefilter(F.col("t"), POSTING), t=title)


@pytest.mark.parametrize(
    "title",
    [
        "Senior Data Engineer", "Staff Platform Engineer", "Software Engineer III", "Sr. ML Engineer",
        "Software Engineer Intern 2027", "VP, Engineering", "Head of Data Engineer Hiring", "Account Executive",
    ],
)
def test_titles_that_fail(one, title):
    assert not one(gates.title_prefilter(F.col("t"), POSTING), t=title)


def test_title_decision_lists_terms_in_pack_order(one):
    found = one(gates.title_decision(F.col("t"), POSTING), t="Data Engineer 2026 New Grad")
    assert found["matched"] == ["new grad", "2026", "data engineer"]
    assert found["excluded"] == []


@pytest.mark.parametrize(
    ("location", "country", "allowed", "expected"),
    [
        ("New York, NY", "", ALLOWED, True), ("Anywhere", "United States of America", ALLOWED, True),
        ("Remote", "", ALLOWED, True), ("Remote", "Canada", ALLOWED, False),
        ("London, United Kingdom", "", ALLOWED, False), ("", "", ALLOWED, False), ("", "", [], True),
        ("Austintown", "", ALLOWED, False), ("Paris", "France", [], True),
    ],
)
def test_location(spark, location, country, allowed, expected):
    df = spark.createDataFrame([(location, country, allowed)], "l STRING, c STRING, a ARRAY<STRING>")
    assert df.select(gates.location_matches(F.col("l"), F.col("c"), F.col("a"))).first()[0] is expected


def test_date_gate_keeps_unknown_dates(spark):
    base = {"title": "Software Engineer I", "location": "New York"}
    rows = [{**base, "date_posted": d} for d in ("2026-05-31", "2026-06-01T09:00:00Z", "")]
    assert [r["date_posted"] for r in judge(spark, rows)] == ["2026-06-01T09:00:00Z", ""]


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("Visa sponsorship available; STEM OPT accepted.", "likely_supported"),
        ("We will not sponsor visas.", "likely_not_supported"),
        ("We offer visa sponsorship but not now or in the future.", "likely_not_supported"),
        ("An active clearance and visa sponsorship available.", "ineligible"),
        ("Ask about sponsorship.", "possibly_supported"),
        ("Great snacks.", "unclear"),
    ],
)
def test_sponsorship(one, body, expected):
    hits = classify.sponsorship_hits(F.col("t"), POSTING)
    assert one(classify.sponsorship_class(hits), t=body) == expected


def test_evidence_and_flags(spark):
    body = "We like ITAR rules. We cannot sponsor. Visa sponsorship available elsewhere."
    row = judge(spark, [{"title": "SWE I", "location": "Austin", "description": body}])[0]
    assert row["sponsorship_classification"] == "ineligible"
    assert row["sponsorship_evidence"] == "We like ITAR rules." or row["sponsorship_evidence"].endswith("We like ITAR rules.")
    assert row["international_student_risk_flags"] == ["itar", "cannot sponsor"]
    assert row["disqualified"] and row["disqualify_reason"].startswith("sponsorship classification 'ineligible': ")


@pytest.mark.parametrize(
    ("title", "body", "expected"),
    [
        ("Engineer (Class of 2026)", "", "compatible_2026"),
        ("Engineer", "Expected graduation in 2027.", "compatible_2027"),
        ("Engineer 2025 or 2027", "", "compatible_2027"),
        ("Engineer 2025", "graduating 2027", "incompatible_2025"),
        ("Engineer", "2024 grads and 2025 graduates", "incompatible_2025"),
        ("Engineer", "for 2029 grads", "future_2029"),
        ("Engineer", "founded in 2019", "unspecified"),
        ("Engineer x2026y", "no year", "unspecified"),
    ],
)
def test_graduation(one, title, body, expected):
    found = one(classify.graduation(F.col("t"), F.col("b"), POSTING), t=title, b=body)
    assert found["match"] == expected


@pytest.mark.parametrize(
    ("title", "expected"),
    [
        ("AI Engineer", "mlai"), ("Maintainer Engineer", "swe"), ("Data Engineer", "data"), ("SRE", "infra"),
        ("Research Engineer", "research"), ("Full Stack Developer", "swe"), ("Accountant", "other"),
        ("HTML Writer", "other"),
    ],
)
def test_family(one, title, expected):
    assert one(classify.family(F.col("t"), POSTING), t=title) == expected


def test_score_worked_example(spark):
    """60 + 4 skills -> 80 -> 28; grad 20; sponsorship 25; place 10; 14 days -> 9."""
    row = judge(spark, [{
        "title": "Software Engineer, New Grad (2027)", "location": "New York, NY", "date_posted": "2026-06-28",
        "description": "Backend work in Python and TypeScript on AWS. Visa sponsorship available.",
    }])[0]
    assert row["overall_score"] == 92
    assert row["role_match_score"] == 80
    assert row["matched_keywords"] == ["2027", "aws", "backend", "new grad", "python", "software engineer", "typescript"]
    assert row["score_explanation"] == (
        "role 28/35 (primary role match (Software Engineer); skills: python, typescript, backend, aws) · "
        "graduation 20/20 (compatible_2027) · sponsorship 25/25 (likely_supported) · location 10/10 (New York, NY) · "
        "recency 9/10 (posted 14d ago) · graduation note: posting targets 2027 grads — matches May 2027 graduation"
    )
    assert row["job_id"].startswith("acme-") and row["country"] == "United States"


def test_score_relations(spark):
    base = {"title": "DevOps Engineer, New Grad", "location": "Austin"}
    rows = judge(spark, [
        {**base, "description": "Visa sponsorship available.", "date_posted": "2026-07-10"},
        {**base, "description": "Snacks.", "date_posted": "2026-07-10"},
        {**base, "description": "Snacks.", "date_posted": "2026-06-01"},
        {**base, "description": "Snacks.", "date_posted": "not a date"},
    ])
    scores = [r["overall_score"] for r in rows]
    assert scores[0] > scores[1] > scores[2]
    # A secondary role overrides the base of the matched terms.
    assert {r["role_match_score"] for r in rows} == {45}
    assert len(rows) == 3 or rows[3]["score_explanation"].count("posting date unknown") == 1
    assert all(0 <= s <= 100 for s in scores)


def test_points_round_half_to_even(one):
    assert one(score.points(F.lit(0.5), 25)) == 12
    assert one(score.points(F.lit(0.7), 25)) == 18
    assert one(score.points(F.lit(0.45), 10)) == 4


def test_refiner_sees_only_uncertain_rows(spark):
    rows = [{"title": "SWE I", "location": "Austin", "description": d} for d in ("We will not sponsor.", "Snacks.")]

    def promote(batch):
        batch["sponsorship_classification"] = "likely_supported"
        return batch

    done = judge(spark, rows, refiner=batch_refiner(promote))
    assert [r["sponsorship_classification"] for r in done] == ["likely_not_supported", "likely_supported"]
    df = conform_records(spark.createDataFrame([{"job_id": "a"}]))
    with pytest.raises(ValueError):
        refine(df, lambda d: d.drop("title"))


def test_pack_is_checked():
    with pytest.raises(ValueError):
        POSTING.with_changes(weights={"role_skills": 1, "graduation": 1, "sponsorship": 1, "location": 1, "recency": 1})
    assert isinstance(POSTING, RulePack) and POSTING.digest_min_score == POSTING.thresholds["strong"]
    assert sum(POSTING.weights.values()) == 100
