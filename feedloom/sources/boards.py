"""Job-board payloads: five board formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_millis_date, epoch_seconds_date, iso_prefix, relative_date
from ..functions.html import strip_html, unescape
from ..functions.text import first_filled, text_or_empty
from ..operators.enrich import enrich
from ..operators.gates import location_matches, title_prefilter, with_source
from ..operators.identity import first_per_key
from .landing import Context, Normalized, detail_cap, open_items, register

KEEP = ["company", "source_type", "fetch_ord"]


def _t(name: str) -> Column:
    return text_or_empty(F.col(f"item.{name}"))


def filled(values: Column) -> Column:
    """Array without blanks."""
    return F.filter(values, lambda v: text_or_empty(v) != "")


@register("greenhouse")
def greenhouse(pages: DataFrame, ctx: Context) -> Normalized:
    items, problems = open_items(
        ctx, pages,
        "jobs ARRAY<STRUCT<id STRING, title STRING, updated_at STRING, first_published STRING, "
        "absolute_url STRING, location STRUCT<name STRING>, departments ARRAY<STRUCT<name STRING>>, "
        "content STRING>>",
        lambda p: p["jobs"],
        needs=F.trim("source_identifier") != "",
    )
    departments = F.transform(F.col("item.departments"), lambda d: d["name"])
    records = items.select(
        *KEEP,
        _t("id").alias("source_job_id"),
        _t("title").alias("title"),
        _t("location.name").alias("location"),
        text_or_empty(F.array_join(filled(departments), ", ")).alias("department"),
        unescape(_t("content")).alias("description"),
        _t("absolute_url").alias("application_url"),
        _t("absolute_url").alias("source_url"),
        iso_prefix(first_filled(F.col("item.first_published"), F.col("item.updated_at"))).alias("date_posted"),
    )
    return Normalized(strip_html(records, "description"), problems)


@register("lever")
def lever(pages: DataFrame, ctx: Context) -> Normalized:
    items, problems = open_items(
        ctx, pages,
        "ARRAY<STRUCT<id STRING, text STRING, createdAt BIGINT, hostedUrl STRING, applyUrl STRING, "
        "categories STRUCT<commitment STRING, location STRING, team STRING>, country STRING, "
        "workplaceType STRING, descriptionPlain STRING, description STRING, "
        "lists ARRAY<STRUCT<text STRING, content STRING>>>>",
        lambda p: p,
        needs=F.trim("source_identifier") != "",
        root="[",
    )
    asked = F.filter(
        F.col("item.lists"), lambda part: F.lower(part["text"]).rlike("requirement|qualification")
    )
    records = items.select(
        *KEEP,
        _t("id").alias("source_job_id"),
        _t("text").alias("title"),
        _t("categories.location").alias("location"),
        _t("country").alias("country"),
        F.lower(_t("workplaceType")).alias("workplace_type"),
        _t("categories.team").alias("department"),
        _t("categories.commitment").alias("employment_type"),
        _t("descriptionPlain").alias("plain"),
        _t("description").alias("description"),
        text_or_empty(
            F.array_join(F.transform(asked, lambda p: text_or_empty(p["content"])), " ")
        ).alias("requirements"),
        first_filled(F.col("item.applyUrl"), F.col("item.hostedUrl")).alias("application_url"),
        _t("hostedUrl").alias("source_url"),
        epoch_millis_date(F.col("item.createdAt")).alias("date_posted"),
    )
    stripped = strip_html(records, "description", "requirements")
    return Normalized(
        stripped.withColumn("description", first_filled(F.col("plain"), F.col("description"))).drop("plain"),
        problems,
    )


@register("ashby")
def ashby(pages: DataFrame, ctx: Context) -> Normalized:
    items, problems = open_items(
        ctx, pages,
        "jobs ARRAY<STRUCT<id STRING, title STRING, location STRING, "
        "secondaryLocations ARRAY<STRUCT<location STRING>>, department STRING, team STRING, "
        "employmentType STRING, isListed BOOLEAN, isRemote BOOLEAN, publishedAt STRING, jobUrl STRING, "
        "applyUrl STRING, descriptionHtml STRING, descriptionPlain STRING>>",
        lambda p: p["jobs"],
        needs=F.trim("source_identifier") != "",
    )
    more = F.coalesce(
        F.transform(F.col("item.secondaryLocations"), lambda s: s["location"]),
        F.array().cast("array<string>"),
    )
    places = F.concat(F.array(F.col("item.location")), more)
    records = items.where(F.coalesce("item.isListed", F.lit(True))).select(
        *KEEP,
        _t("id").alias("source_job_id"),
        _t("title").alias("title"),
        F.array_join(filled(places), "; ").alias("location"),
        F.when(F.col("item.isRemote"), F.lit("remote")).otherwise(F.lit("")).alias("workplace_type"),
        first_filled(F.col("item.department"), F.col("item.team")).alias("department"),
        _t("employmentType").alias("employment_type"),
        _t("descriptionHtml").alias("description"),
        _t("descriptionPlain").alias("plain"),
        first_filled(F.col("item.applyUrl"), F.col("item.jobUrl")).alias("application_url"),
        _t("jobUrl").alias("source_url"),
        iso_prefix(F.col("item.publishedAt")).alias("date_posted"),
    )
    stripped = strip_html(records, "description")
    return Normalized(
        stripped.withColumn("description", first_filled(F.col("description"), F.col("plain"))).drop("plain"),
        problems,
    )


def _wants_detail(ctx: Context) -> Column:
    """Place and title are promising enough to look at the detail answer."""
    return location_matches(F.col("location"), F.col("country"), F.col("locations")) & title_prefilter(
        F.col("title"), ctx.pack
    )


def with_details(listing: DataFrame, ctx: Context, predicate: Column, schema: str) -> DataFrame:
    """Attach parsed detail answers (`info`, NULL without one), within a source's cap if it has one."""
    if ctx.details is None:
        return listing.withColumn("info", F.from_json(F.lit(None).cast("string"), schema))
    joined = enrich(listing, ctx.details, predicate, ["fetch_ord"], "detail_key", detail_cap(ctx))
    return joined.withColumn("info", F.from_json(F.col("detail.body"), schema)).drop("detail")


@register("workday")
def workday(pages: DataFrame, ctx: Context) -> Normalized:
    parts = F.split(F.rtrim(F.trim("source_identifier"), F.lit("/")), "/")
    items, problems = open_items(
        ctx, pages,
        "jobPostings ARRAY<STRUCT<title STRING, externalPath STRING, locationsText STRING, "
        "postedOn STRING, bulletFields ARRAY<STRING>>>",
        lambda p: p["jobPostings"],
        needs=F.size(parts) == 3,
    )
    once = first_per_key(
        items.withColumn("detail_key", F.col("item.externalPath")), ["company", "detail_key"], ["fetch_ord"]
    )
    path = F.col("detail_key")
    address = F.concat(F.lit("https://"), F.get(parts, F.lit(0)), F.lit("/en-US/"), F.get(parts, F.lit(2)), path)
    listing = once.select(
        *KEEP,
        "detail_key",
        F.coalesce(
            F.get("item.bulletFields", F.lit(0)), F.substring_index(path, "/", -1)
        ).alias("source_job_id"),
        _t("title").alias("title"),
        _t("locationsText").alias("location"),
        F.lit("").alias("country"),
        relative_date(F.col("item.postedOn"), ctx.run_ts).alias("date_posted"),
        address.alias("application_url"),
        address.alias("source_url"),
    )
    placed = with_source(listing, ctx.sources, "locations")
    detailed = with_details(
        placed, ctx, _wants_detail(ctx),
        "jobPostingInfo STRUCT<jobDescription STRING, timeType STRING, location STRING, "
        "country STRING, postedOn STRING, externalUrl STRING>",
    )
    info = lambda name: F.col(f"info.jobPostingInfo.{name}")
    # `country` may be an object or a plain text; only the object's name counts.
    described = F.get_json_object(info("country"), "$.descriptor")
    records = detailed.select(
        *KEEP, "source_job_id", "title",
        first_filled(info("location"), F.col("location")).alias("location"),
        first_filled(described, F.col("country")).alias("country"),
        text_or_empty(info("timeType")).alias("employment_type"),
        text_or_empty(info("jobDescription")).alias("description"),
        first_filled(info("externalUrl"), F.col("application_url")).alias("application_url"),
        "source_url",
        first_filled(relative_date(info("postedOn"), ctx.run_ts), F.col("date_posted")).alias("date_posted"),
    )
    return Normalized(strip_html(records, "description"), problems)


@register("eightfold")
def eightfold(pages: DataFrame, ctx: Context) -> Normalized:
    ident = F.rtrim(F.trim("source_identifier"), F.lit("/"))
    host, domain = F.substring_index(ident, "/", 1), F.regexp_replace(ident, "^[^/]*/?", "")
    items, problems = open_items(
        ctx, pages,
        "status STRING, errorMsg STRING, data STRUCT<positions ARRAY<STRUCT<id STRING, "
        "displayJobId STRING, name STRING, locations ARRAY<STRING>, standardizedLocations ARRAY<STRING>, "
        "postedTs STRING, creationTs STRING, department STRING, workLocationOption STRING, "
        "positionUrl STRING>>>",
        lambda p: p["data"]["positions"],
        needs=(host != "") & (domain != ""),
        failed=lambda p: (text_or_empty(p["status"]) == "failure") | (text_or_empty(p["errorMsg"]) != ""),
    )
    once = first_per_key(
        items.withColumn("detail_key", F.col("item.id")), ["company", "detail_key"], ["fetch_ord"]
    )
    places = F.when(F.size("item.locations") > 0, F.col("item.locations")).otherwise(
        F.col("item.standardizedLocations")
    )
    path = first_filled(
        F.col("item.positionUrl"), F.concat(F.lit("/careers/job/"), F.col("detail_key"))
    )
    address = F.concat(F.lit("https://"), host, path, F.lit("?domain="), domain)
    posted = F.when(~F.coalesce(F.col("item.postedTs"), F.lit("0")).isin("0", ""), F.col("item.postedTs")).otherwise(
        F.col("item.creationTs")
    )
    listing = once.select(
        *KEEP,
        "detail_key",
        first_filled(F.col("item.displayJobId"), F.col("detail_key")).alias("source_job_id"),
        _t("name").alias("title"),
        text_or_empty(F.array_join(places, "; ")).alias("location"),
        F.lit("").alias("country"),
        _t("department").alias("department"),
        _t("workLocationOption").alias("workplace_type"),
        epoch_seconds_date(posted).alias("date_posted"),
        address.alias("application_url"),
        address.alias("source_url"),
    )
    placed = with_source(listing, ctx.sources, "locations")
    detailed = with_details(
        placed, ctx, _wants_detail(ctx),
        "data STRUCT<location STRING, jobDescription STRING, "
        "efcustomTextEmploymentType ARRAY<STRING>, publicUrl STRING>",
    )
    info = lambda name: F.col(f"info.data.{name}")
    records = detailed.select(
        *KEEP, "source_job_id", "title",
        first_filled(info("location"), F.col("location")).alias("location"),
        "country", "department", "workplace_type",
        text_or_empty(F.get(info("efcustomTextEmploymentType"), F.lit(0))).alias("employment_type"),
        text_or_empty(info("jobDescription")).alias("description"),
        first_filled(info("publicUrl"), F.col("application_url")).alias("application_url"),
        first_filled(info("publicUrl"), F.col("source_url")).alias("source_url"),
        "date_posted",
    )
    return Normalized(strip_html(records, "description"), problems)
