"""The query catalogue over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import (
    age_days, date_ordinal, epoch_millis_date, epoch_seconds_date, local_stamps, relative_date,
    us_date, utc_stamp,
)
from ..functions.labels import score_band
from ..functions.paths import as_text, dig_text, fill_template
from ..functions.text import md_escape, normalize_ws, passage, phrase_hits, truncate
from ..functions.urls import absolute_url, canonical_url
from ..operators import (
    classify, enrich, gates, health, identity, lifecycle, rank, refine, report, score, summary,
)
from ..rules import CORPUS
from ..schema import SOURCE_TYPES, conform_records
from ..session import scratch_path, written
from ..sources import state
from . import views
from .run import judge_records
from .views import FETCH_TS, RUN_TS, run_ts, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PACK = CORPUS


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(values: Column | str) -> Column:
    return F.array_join(values, "; ")


# ------------------------------------------------------------------ scalars
@query
def canonical_urls(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", canonical_url(F.col("url")).alias("canonical_url")
    )


@query
def site_links(spark, folder):
    pages = table(spark, folder, "pages")
    url = F.col("url")
    return pages.select(
        "page_id",
        absolute_url(url, F.lit("/jobs")).alias("rooted"),
        absolute_url(url, F.lit("next")).alias("beside"),
        absolute_url(url, F.lit("//cdn.example.org/x")).alias("other_host"),
        absolute_url(url, F.lit("")).alias("itself"),
    )


@query
def url_dedup_first_wins(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical_url"))
    return identity.first_per_key(pages, ["canonical_url"], ["page_id"])


@query
def normalized_text(spark, folder):
    docs = views.doc_texts(spark, folder)
    return docs.select("doc_id", normalize_ws(F.col("description")).alias("text"))


@query
def evidence_passages(spark, folder):
    docs = views.doc_texts(spark, folder)
    phrase = F.get(phrase_hits(F.col("description"), PACK.positive), F.lit(0))
    found = docs.select("doc_id", "description", phrase.alias("phrase")).where("phrase IS NOT NULL")
    return found.select("doc_id", "phrase", passage(F.col("description"), F.col("phrase")).alias("passage"))


@query
def truncated_cells(spark, folder):
    docs = views.doc_texts(spark, folder)
    return docs.select("doc_id", truncate(F.col("description"), 140).alias("cell"))


@query
def escaped_cells(spark, folder):
    docs = views.doc_texts(spark, folder)
    return docs.select("doc_id", md_escape(F.col("description")).alias("cell"))


@query
def date_texts(spark, folder):
    day = F.col("o_orderdate")
    shown = F.when(F.col("o_orderstatus") == "F", F.date_format(day, "MMMM d, yyyy")).when(
        F.col("o_orderstatus") == "O", F.date_format(day, "MMM d, yyyy")
    ).otherwise(F.date_format(day, "yyyy-MM-dd"))
    seconds = F.unix_timestamp(day)
    return table(spark, folder, "orders").select(
        "o_orderkey",
        us_date(shown).alias("from_us"),
        epoch_seconds_date(seconds).alias("from_seconds"),
        epoch_millis_date(seconds * 1000).alias("from_millis"),
        date_ordinal(F.date_format(day, "yyyy-MM-dd")).alias("ordinal"),
    )


@query
def relative_dates(spark, folder):
    status, n = F.col("o_orderstatus"), F.dayofmonth("o_orderdate")
    shown = (
        F.when(n == 1, F.lit("Posted Today"))
        .when(n == 2, F.lit("Posted Yesterday"))
        .when(n == 31, F.lit("Posted 30+ ago"))
        .when(status == "P", F.lit("soon"))
        .otherwise(F.concat(F.lit("Posted "), n.cast("string"), F.lit("+ Days Ago")))
    )
    return table(spark, folder, "orders").select(
        "o_orderkey", relative_date(shown, F.col("o_orderdate")).alias("posted")
    )


@query
def run_stamps(spark, folder):
    utc, local = local_stamps(F.col("ts"))
    return table(spark, folder, "events").select(
        "event_id", utc_stamp(F.col("ts")).alias("stamp"), utc.alias("utc"), local.alias("local")
    )


@query
def json_path_values(spark, folder):
    events = table(spark, folder, "events").withColumn("props_v", F.try_parse_json("props"))
    return events.select(
        "event_id",
        dig_text(F.col("props_v"), "k").alias("k"),
        dig_text(F.col("props_v"), "k.missing").alias("missing"),
        fill_template("https://example.com/{k}/apply", k=dig_text(F.col("props_v"), "k")).alias("link"),
    )


@query
def json_list_values(spark, folder):
    """A path that maps over a list: titles of a source's nested sections."""
    docs = views.doc_texts(spark, folder)
    parts = F.transform(
        F.split("title", " "), lambda w: F.struct(w.alias("word"), F.array(F.length(w)).alias("sizes"))
    )
    body = F.to_json(F.struct(F.struct(parts.alias("parts")).alias("result")))
    parsed = docs.select("doc_id", F.try_parse_json(body).alias("v"), F.to_json(F.split("title", " ")).alias("raw"))
    return parsed.select(
        "doc_id",
        dig_text(F.col("v"), "result.parts.word", "|").alias("words"),
        dig_text(F.col("v"), "result.parts.0.sizes", "|").alias("first_size"),
        as_text(F.col("raw"), "|").alias("listed"),
    )


# -------------------------------------------------------------------- gates
@query
def title_gate(spark, folder):
    decided = gates.with_title_decision(views.doc_texts(spark, folder), PACK)
    return decided.select(
        "doc_id",
        F.col("decision.passed").alias("passed"),
        joined("decision.matched").alias("matched"),
        joined("decision.excluded").alias("excluded"),
    )


@query
def location_gate(spark, folder):
    placed = gates.with_source(views.records(spark, folder), views.sources(spark, folder), "locations")
    return placed.select(
        "doc_id",
        gates.location_matches(F.col("location"), F.col("country"), F.col("locations")).alias("allowed"),
    )


@query
def date_floor(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted")
    )
    return orders.where(gates.posted_since(F.col("posted"), PACK.min_posted_date))


@query
def gated_rows(spark, folder):
    kept = gates.gate(views.records(spark, folder), views.sources(spark, folder), PACK)
    return kept.select("doc_id", "company", "country", joined("decision.matched").alias("matched"))


@query
def enabled_sources(spark, folder):
    return views.sources(spark, folder).select(
        "name", gates.skipped_source(F.col("enabled"), F.col("source_type")).alias("skipped")
    )


@query
def selected_sources(spark, folder):
    return gates.only_companies(views.sources(spark, folder), ["SRC1", "Src12", "src7"]).select("name", "priority")


# -------------------------------------------------------------- classifiers
@query
def phrase_hit_lists(spark, folder):
    docs = views.doc_texts(spark, folder)
    hits = classify.sponsorship_hits(F.col("description"), PACK)
    return docs.select("doc_id", hits.alias("h")).select(
        "doc_id", *[joined(f"h.{k}").alias(k) for k in ("ineligible", "negative", "positive", "weak_positive")]
    )


@query
def priority_class(spark, folder):
    done = classify.with_sponsorship(views.doc_texts(spark, folder), PACK)
    return done.select(
        "doc_id", "sponsorship_classification", "sponsorship_evidence",
        joined("international_student_risk_flags").alias("risk_flags"),
    )


@query
def year_class(spark, folder):
    years = views.year_texts(spark, folder)
    return classify.with_graduation(years, PACK).select("o_orderkey", "graduation_match", "graduation_note")


@query
def title_family(spark, folder):
    docs = views.doc_texts(spark, folder)
    return docs.select("doc_id", classify.family(F.col("title"), PACK).alias("family"))


# ------------------------------------------------------------------ scoring
@query
def role_score(spark, folder):
    decided = gates.with_title_decision(views.doc_texts(spark, folder), PACK)
    text = F.concat_ws(" ", "title", "description", "requirements")
    role = score.role_match(F.col("title"), F.col("decision.matched"), text, PACK)
    scored = decided.withColumn("role", role)
    return scored.select(
        "doc_id",
        F.col("role.score").alias("role_match_score"),
        score.points(F.col("role.score") / 100, PACK.weights["role_skills"]).alias("points"),
        joined(score.matched_keywords(F.col("decision.matched"), F.col("role.skills"))).alias("keywords"),
    )


@query
def recency_score(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", age_days(F.date_format("o_orderdate", "yyyy-MM-dd"), run_ts()).alias("age")
    )
    return orders.select(
        "o_orderkey", "age",
        score.points(score.recency_share(F.col("age"), PACK), PACK.weights["recency"]).alias("points"),
    )


def scored(spark, folder) -> DataFrame:
    """All records gated, classified and scored; `fetch_ord` is the document id."""
    feed = conform_records(views.records(spark, folder).withColumn("fetch_ord", F.col("doc_id")), "fetch_ord")
    return judge_records(feed, views.sources(spark, folder), PACK, run_ts())


def judged(spark, folder) -> DataFrame:
    """The scored records as a saved table, without the long texts.

    Reports sort and filter on scores: on a plain plan the sort's sampling and
    each pushed-down filter would score every text again.
    """
    return written(scored(spark, folder).drop("description", "requirements"), "judged")


@query
def overall_score(spark, folder):
    return scored(spark, folder).select(
        "job_id", "role_match_score", "graduation_match", "sponsorship_classification", "overall_score",
        "score_explanation", "disqualified", "disqualify_reason",
        joined("matched_keywords").alias("keywords"),
    )


@query
def score_bands(spark, folder):
    return summary.band_counts(scored(spark, folder), PACK)


@query
def refined_classes(spark, folder):
    """Refine only uncertain rows: a long text with a weak signal is possible."""

    def stronger(df: DataFrame) -> DataFrame:
        longer = F.length("description") > 2000
        return df.withColumn(
            "sponsorship_classification",
            F.when(longer, F.lit("possibly_supported")).otherwise(F.col("sponsorship_classification")),
        )

    done = classify.with_sponsorship(views.doc_texts(spark, folder), PACK)
    return refine.refine(done, stronger).select("doc_id", "sponsorship_classification")


# ----------------------------------------------------------------- identity
@query
def fingerprints(spark, folder):
    return views.records(spark, folder).select("doc_id", identity.record_fingerprint().alias("fingerprint"))


@query
def record_ids(spark, folder):
    rows = views.records(spark, folder)
    blank = F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.col("source_job_id"))
    return rows.withColumn("source_job_id", blank).select("doc_id", identity.record_id().alias("record_id"))


#: What the merges hold in place of a text.
TEXT = ("text_key",)


def merged(spark, folder) -> lifecycle.Merge:
    """A merge without texts: rows name theirs by `text_key`."""
    known, ok = views.history(spark, folder), views.ok_sources(spark, folder)
    return lifecycle.merge_state(
        views.fetched(spark, folder, known=known, ok=ok, carry=TEXT), views.previous_state(spark, folder, known, TEXT),
        views.archived_state(spark, folder, known, TEXT), ok,
        run_ts(FETCH_TS), PACK.archive_after_missing_runs, written, TEXT,
    )


def whole(merge: lifecycle.Merge, spark, folder) -> lifecycle.Merge:
    """The merge with its texts, for outputs that hold them."""
    return lifecycle.Merge(views.with_texts(merge.state, spark, folder))


def judged_merge(spark, folder) -> lifecycle.Merge:
    """The merge a real run makes: fetched rows are gated and scored first.  It holds no texts, and fetched rows name none."""
    known, ok = views.history(spark, folder), views.ok_sources(spark, folder)
    scores = judge_records(
        views.fetched(spark, folder, ok=ok), views.sources(spark, folder), PACK, run_ts()
    )
    fresh = written(scores.drop("description", "requirements"), "judged").withColumn("text_key", F.lit(None).cast("string"))
    return lifecycle.merge_state(
        fresh, views.previous_state(spark, folder, known, TEXT), views.archived_state(spark, folder, known, TEXT),
        ok, run_ts(FETCH_TS), PACK.archive_after_missing_runs, written, TEXT,
    )


@query
def identity_match_tiers(spark, folder):
    known = views.history(spark, folder)
    fresh = views.fetched(spark, folder, known=known).withColumn("job_id", identity.record_id())
    found = lifecycle.resolve(fresh, views.previous_state(spark, folder, known), views.archived_state(spark, folder, known))
    return found.select(
        "fetch_ord", lifecycle.match_tier(F.col("rank")).alias("tier"),
        F.coalesce("history.job_id", F.lit("")).alias("known_as"),
    )


_STATE = ["job_id", "company", "first_seen", "last_seen", "status", "consecutive_missing",
          "announced", "lifecycle", "matched_by"]


@query
def lifecycle_merge(spark, folder):
    return merged(spark, folder).state.select(*_STATE)


@query
def lifecycle_counts(spark, folder):
    return merged(spark, folder).state.groupBy("lifecycle").agg(F.count(F.lit(1)).alias("n"))


@query
def active_rows(spark, folder):
    return merged(spark, folder).active.select("job_id", "title", "application_url", "first_seen")


@query
def reopened_rows(spark, folder):
    return merged(spark, folder).reopened.select(*_STATE)


@query
def closed_this_run(spark, folder):
    return merged(spark, folder).closed.select(*_STATE)


@query
def digest_rows(spark, folder):
    rows = gates.digest_eligible(judged_merge(spark, folder).state, PACK)
    return rows.select("job_id", "overall_score", "sponsorship_classification")


@query
def mark_announced(spark, folder):
    merge = judged_merge(spark, folder)
    sent = gates.digest_eligible(merge.state, PACK)
    return lifecycle.mark_announced(merge.active, sent).select("job_id", "announced")


# ------------------------------------------------------------------- detail
def _detailed(spark, folder, cap: int | None = None) -> DataFrame:
    listing = views.doc_texts(spark, folder).withColumn("detail_key", F.col("doc_id"))
    details = table(spark, folder, "labels").select(F.col("doc_id").alias("detail_key"), "quality", "toxic")
    owned = details.join(listing.select("company", "detail_key"), "detail_key")
    done = enrich.enrich(listing, owned, gates.title_prefilter(F.col("title"), PACK), ["doc_id"], "detail_key", cap)
    return done.select(
        "doc_id", "company",
        F.col("detail.quality").alias("quality"), F.col("detail.toxic").alias("toxic"),
    )


@query
def detail_enrichment(spark, folder):
    """Documents as a listing, their labels as landed details."""
    return _detailed(spark, folder)


@query
def detail_enrichment_capped(spark, folder):
    """The same with an explicit cap of 40 details per source."""
    return _detailed(spark, folder, 40)


# ------------------------------------------------------------------- health
def shown_health(folded: DataFrame) -> DataFrame:
    return folded.select(
        "company", utc_stamp(F.col("last_attempt")).alias("last_attempt"),
        F.coalesce(utc_stamp(F.col("last_success")), F.lit("")).alias("last_success"),
        "status", "jobs_fetched", "consecutive_failures", "runs",
    )


@query
def source_health_fold(spark, folder):
    return shown_health(health.fold(views.run_log(spark, folder)))


def folded_health(spark, folder) -> DataFrame:
    """The folded run log in the shape of a saved health table."""
    category = F.when(F.col("status") == "failed", F.lit("network_error")).when(
        F.col("status") == "skipped", F.lit("unsupported")
    ).otherwise(F.col("status"))
    return source_health_fold(spark, folder).select(
        "company", F.lit("json").alias("source_type"), "last_attempt", "last_success", "status",
        "jobs_fetched", category.alias("error_category"),
        F.concat(F.lit("last run of "), F.col("company"), F.lit(" | "), F.col("last_attempt")).alias("error_message"),
        F.col("consecutive_failures").cast("int").alias("consecutive_failures"),
    )


def step_outcomes(spark, folder) -> DataFrame:
    """This run's outcomes: documents are the pages and the records; a source
    whose documents carry a toxic label had a broken page."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("company"))
    labels = table(spark, folder, "labels")
    rows = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    broken = docs.join(labels.where("toxic = 1 AND quality = 0"), "doc_id").select(
        "company", F.lit("structure_changed").alias("category"),
        F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("message"),
    )
    return health.run_outcomes(views.sources(spark, folder), docs, rows, broken)


@query
def source_outcomes(spark, folder):
    return step_outcomes(spark, folder)


@query
def source_health_step(spark, folder):
    return health.step(folded_health(spark, folder), step_outcomes(spark, folder), utc_stamp(run_ts(FETCH_TS)))


@query
def source_problems(spark, folder):
    return health.problems(folded_health(spark, folder))


@query
def source_validation(spark, folder):
    records = views.doc_texts(spark, folder)
    return summary.source_validation(step_outcomes(spark, folder), records, views.sources(spark, folder), "doc_id")


@query
def failing_sources(spark, folder):
    return summary.failing_sources(source_validation(spark, folder))


# ---------------------------------------------------------------- summaries
@query
def run_summary(spark, folder):
    return summary.run_summary(folded_health(spark, folder), judged_merge(spark, folder).state, PACK)


@query
def report_summary(spark, folder):
    return summary.report_summary(judged(spark, folder), folded_health(spark, folder), PACK)


@query
def rows_per_source(spark, folder):
    return health.rows_per_source(views.doc_texts(spark, folder), views.sources(spark, folder))


@query
def company_list(spark, folder):
    return summary.companies(views.doc_texts(spark, folder))


@query
def unknown_sources(spark, folder):
    wanted = views.run_log(spark, folder).select(F.upper("company").alias("name"))
    return gates.unknown_companies(wanted, views.sources(spark, folder))


@query
def duplicate_sources(spark, folder):
    listed = views.run_log(spark, folder).groupBy("company", "status").count()
    return summary.duplicate_names(listed.select(F.col("company").alias("name")))


@query
def invalid_sources(spark, folder):
    listed = views.sources(spark, folder).withColumn(
        "name", F.when(F.col("source_no") == 3, F.lit("  ")).otherwise(F.col("name"))
    )
    return summary.invalid_sources(listed, SOURCE_TYPES)


# ------------------------------------------------------------------ ranking
@query
def ranked_documents(spark, folder):
    ranked = rank.sort_recommended(judged(spark, folder), views.sources(spark, folder))
    return ranked.select("job_id", "overall_score", "date_posted", "priority", "company")


@query
def top_k_with_rest(spark, folder):
    rows = rank.with_priority(gates.visible(judged(spark, folder)), views.sources(spark, folder))
    return rank.top_with_rest(rows, rank.recommended_order(), 15, report.chat_line())


def _explore(spark, folder, by: str, conditions: rank.Explore) -> DataFrame:
    rows = judged(spark, folder)
    fresh = rows.where("date_posted >= '1998-01-01'")
    found = rank.explore(rows, fresh, conditions, PACK, by)
    return found.select("job_id", "company", "title", "overall_score", "date_posted")


@query
def explore_by_score(spark, folder):
    return _explore(spark, folder, "score", rank.Explore(query=" The ", min_score=40, family="articles"))


@query
def explore_by_date(spark, folder):
    return _explore(spark, folder, "date", rank.Explore(location="e", show_disqualified=True))


@query
def explore_by_company(spark, folder):
    return _explore(
        spark, folder, "company",
        rank.Explore(company="src4", sponsorship="likely_supported", new_only=True),
    )


@query
def explore_page(spark, folder):
    """A page of an explicit size with the number of all matches."""
    rows = judged(spark, folder)
    page = rank.explore_page(rows, rows, rank.Explore(location="e", show_disqualified=True), PACK, "date", 400)
    return page.select("job_id", "company", "title", "overall_score", "date_posted", "matched")


@query
def new_only(spark, folder):
    merge = merged(spark, folder)
    return rank.only_new(merge.active, merge.new).select("job_id", "company")


# -------------------------------------------------------------------- sinks
@query
def saved_records(spark, folder):
    """The active rows, saved as JSON lines and loaded again."""
    path = scratch_path(spark, "active")
    state.save_records(whole(merged(spark, folder), spark, folder).active, path, run_ts(FETCH_TS), "json")
    return state.load_records(spark, path, "json").select("job_id", "title", "application_url", "first_seen")


@query
def saved_envelope(spark, folder):
    path = scratch_path(spark, "active")
    state.save_records(whole(merged(spark, folder), spark, folder).active, path, run_ts(FETCH_TS))
    return spark.read.schema("generated_at STRING, count BIGINT").json(f"{path}/envelope")


@query
def saved_csv(spark, folder):
    path = scratch_path(spark, "csv")
    state.save_csv(whole(merged(spark, folder), spark, folder).active, path)
    return state.load_csv(spark, path).select("job_id", "title", "application_url", "first_seen")


@query
def saved_health(spark, folder):
    path = scratch_path(spark, "health")
    state.save_health(source_health_step(spark, folder), path, run_ts(FETCH_TS))
    return state.load_health(spark, path)


@query
def run_outputs(spark, folder):
    """All outputs of a run whose digest was delivered; its rows are saved as announced."""
    path = scratch_path(spark, "run")
    state.write_outputs(
        whole(judged_merge(spark, folder), spark, folder), source_health_step(spark, folder), views.sources(spark, folder), path,
        run_ts(FETCH_TS), PACK, deliver=lambda digest: True,
    )
    return state.load_records(spark, f"{path}/active").select("job_id", "announced")


# ------------------------------------------------------------------ reports
#: What the lines of a report are sorted by.
SORTED = ("overall_score", "date_posted", "priority", "company", "job_id")


@query
def report_lines(spark, folder):
    lines = report.report_lines(judged(spark, folder), views.sources(spark, folder), PACK)
    return lines.select("band", *SORTED, "line")


@query
def new_report_lines(spark, folder):
    lines = report.new_report_lines(judged_merge(spark, folder).new, views.sources(spark, folder))
    return lines.select(*SORTED, "line")


@query
def digest_lines(spark, folder):
    lines = report.digest_lines(judged_merge(spark, folder).state, views.sources(spark, folder), PACK)
    return lines.select(*SORTED, "line")


@query
def explorer_cards(spark, folder):
    rows = judged(spark, folder)
    shown = report.explorer_view(rows, rows.where("date_posted >= '1998-01-01'"))
    return shown.select("job_id", "is_new", "sponsorship_label", "evidence_line")
