"""JSON endpoints: presets of known career APIs and the configurable mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_prefix, us_date
from ..functions.html import strip_html
from ..functions.paths import as_text, dig_list_by, dig_text_by
from ..functions.text import first_filled, let, literals, text_or_empty
from ..operators.gates import title_prefilter
from ..operators.identity import first_per_key, record_fingerprint
from .boards import KEEP, _t, filled, with_details
from .landing import Context, Normalized, open_items, opened_rows, register, split_opened

# Fixed value: the country the presets ask their API for.
US = "United States"


def _once(items: DataFrame, key: Column) -> DataFrame:
    return first_per_key(items.withColumn("key", key), ["company", "key"], ["fetch_ord"])


def _strip_and_join(df: DataFrame, parts: list[str]) -> DataFrame:
    """Strip each part on its own, then join the non-empty ends by spaces."""
    return strip_html(df, *parts).withColumn("description", F.trim(F.concat_ws(" ", *parts)))


@register("json", "amazon")
def amazon(pages: DataFrame, ctx: Context) -> Normalized:
    items, problems = open_items(
        ctx, pages,
        "jobs ARRAY<STRUCT<id_icims STRING, id STRING, job_path STRING, title STRING, "
        "normalized_location STRING, location STRING, job_category STRING, job_schedule_type STRING, "
        "description STRING, basic_qualifications STRING, preferred_qualifications STRING, "
        "posted_date STRING>>",
        lambda p: p["jobs"],
    )
    once = _once(items, first_filled(F.col("item.id_icims"), F.col("item.id"), F.col("item.job_path")))
    path = _t("job_path")
    address = F.when(
        F.startswith(path, F.lit("/")), F.concat(F.lit("https://www.amazon.jobs"), path)
    ).otherwise(path)
    records = once.select(
        *KEEP,
        F.col("key").alias("source_job_id"),
        _t("title").alias("title"),
        as_text(first_filled(F.col("item.normalized_location"), F.col("item.location"))).alias("location"),
        F.lit(US).alias("country"),
        _t("job_category").alias("department"),
        _t("job_schedule_type").alias("employment_type"),
        _t("description").alias("body_text"),
        _t("basic_qualifications").alias("requirements"),
        _t("preferred_qualifications").alias("preferred"),
        address.alias("application_url"),
        address.alias("source_url"),
        us_date(F.col("item.posted_date")).alias("date_posted"),
    )
    joined = _strip_and_join(records, ["body_text", "requirements", "preferred"])
    return Normalized(joined.drop("body_text", "preferred"), problems)


@register("json", "google")
def google(pages: DataFrame, ctx: Context) -> Normalized:
    items, problems = open_items(
        ctx, pages,
        "jobs ARRAY<STRUCT<id STRING, title STRING, locations ARRAY<STRUCT<display STRING>>, "
        "description STRING, summary STRING, qualifications STRING, responsibilities STRING, "
        "apply_url STRING, publish_date STRING, created STRING>>",
        lambda p: p["jobs"],
    )
    once = _once(items, F.col("item.id")).withColumn("own", F.substring_index("key", "/", -1))
    page = F.concat(F.lit("https://careers.google.com/jobs/results/"), F.col("own"), F.lit("/"))
    records = once.select(
        *KEEP,
        F.col("own").alias("source_job_id"),
        _t("title").alias("title"),
        text_or_empty(
            F.array_join(F.transform("item.locations", lambda x: x["display"]), "; ")
        ).alias("location"),
        F.lit(US).alias("country"),
        _t("description").alias("body_text"),
        _t("summary").alias("summary"),
        _t("qualifications").alias("requirements"),
        _t("responsibilities").alias("duties"),
        first_filled(F.col("item.apply_url"), page).alias("application_url"),
        page.alias("source_url"),
        iso_prefix(first_filled(F.col("item.publish_date"), F.col("item.created"))).alias("date_posted"),
    )
    joined = _strip_and_join(records, ["body_text", "summary", "requirements", "duties"])
    return Normalized(joined.drop("body_text", "summary", "duties"), problems)


@register("json", "uber")
def uber(pages: DataFrame, ctx: Context) -> Normalized:
    place = "STRUCT<city: STRING, region: STRING, country: STRING, countryName: STRING>"
    items, problems = open_items(
        ctx, pages,
        f"data STRUCT<results ARRAY<STRUCT<id STRING, title STRING, department STRING, "
        f"description STRING, creationDate STRING, location {place}, allLocations ARRAY<{place}>>>>",
        lambda p: p["data"]["results"],
    )
    once = _once(items, F.col("item.id"))
    every = F.when(F.size("item.allLocations") > 0, F.col("item.allLocations")).otherwise(
        F.array("item.location")
    )
    at_home = F.filter(
        every, lambda x: first_filled(x["countryName"], x["country"]).isin("United States", "USA")
    )
    pieces = F.transform(at_home, lambda x: F.array_join(filled(F.array(x["city"], x["region"])), ", "))
    address = F.concat(F.lit("https://www.uber.com/global/en/careers/list/"), F.col("key"), F.lit("/"))
    records = once.select(
        *KEEP,
        F.col("key").alias("source_job_id"),
        _t("title").alias("title"),
        text_or_empty(F.array_join(pieces, "; ")).alias("location"),
        F.lit(US).alias("country"),
        _t("department").alias("department"),
        _t("description").alias("description"),
        address.alias("application_url"),
        address.alias("source_url"),
        iso_prefix(F.col("item.creationDate")).alias("date_posted"),
    )
    return Normalized(strip_html(records, "description"), problems)


# City marks that keep a posting of this feed.
_KEPT_CITIES = ["New York", "NYC", "Austin", "Chicago", "US"]


@register("json", "janestreet")
def janestreet(pages: DataFrame, ctx: Context) -> Normalized:
    items, problems = open_items(
        ctx, pages,
        "ARRAY<STRUCT<id STRING, position STRING, title STRING, city STRING, team STRING, "
        "duration STRING, type STRING, overview STRING, description STRING>>",
        lambda p: p,
        root="[",
    )
    address = F.concat(
        F.lit("https://www.janestreet.com/join-jane-street/position/"), _t("id"), F.lit("/")
    )
    records = items.where(F.exists(literals(_KEPT_CITIES), lambda mark: F.contains(_t("city"), mark))).select(
        *KEEP,
        _t("id").alias("source_job_id"),
        first_filled(F.col("item.position"), F.col("item.title")).alias("title"),
        _t("city").alias("location"),
        F.lit(US).alias("country"),
        _t("team").alias("department"),
        first_filled(F.col("item.duration"), F.col("item.type")).alias("employment_type"),
        as_text(first_filled(F.col("item.overview"), F.col("item.description")), " ").alias("description"),
        address.alias("application_url"),
        address.alias("source_url"),
    )
    return Normalized(strip_html(records, "description"), problems)


_SECTIONS = ["companyDescription", "jobDescription", "qualifications", "additionalInformation"]


@register("json", "smartrecruiters")
def smartrecruiters(pages: DataFrame, ctx: Context) -> Normalized:
    board = F.regexp_replace("source_identifier", "^[^:]*:?", "")
    items, problems = open_items(
        ctx, pages,
        "content ARRAY<STRUCT<id STRING, name STRING, ref STRING, releasedDate STRING, "
        "location STRUCT<city: STRING, region: STRING, country: STRING>, "
        "function STRUCT<label: STRING>, typeOfEmployment STRUCT<label: STRING>>>",
        lambda p: p["content"],
        needs=board != "",
    )
    land = F.lower(_t("location.country"))
    once = _once(items.where((land == "") | land.isin("us", "usa", "united states")), F.col("item.id"))
    address = F.concat(F.lit("https://jobs.smartrecruiters.com/"), board, F.lit("/"), F.col("key"))
    listing = once.select(
        *KEEP,
        F.col("key").alias("detail_key"),
        F.col("key").alias("source_job_id"),
        _t("name").alias("title"),
        F.array_join(filled(F.array("item.location.city", "item.location.region")), ", ").alias("location"),
        F.lit(US).alias("country"),
        _t("function.label").alias("department"),
        _t("typeOfEmployment.label").alias("employment_type"),
        _t("ref").alias("ref"),
        address.alias("application_url"),
        address.alias("source_url"),
        iso_prefix(F.col("item.releasedDate")).alias("date_posted"),
    )
    sections = ", ".join(f"{s}: STRUCT<text: STRING>" for s in _SECTIONS)
    detailed = with_details(
        listing, ctx, (F.col("ref") != "") & title_prefilter(F.col("title"), ctx.pack),
        f"jobAd STRUCT<sections: STRUCT<{sections}>>",
    )
    texts = detailed.withColumns(
        {f"part_{s}": text_or_empty(F.col(f"info.jobAd.sections.{s}.text")) for s in _SECTIONS}
    ).drop("info", "ref", "detail_key")
    parts = [f"part_{s}" for s in _SECTIONS]
    joined = _strip_and_join(texts, parts).withColumn("requirements", F.col("part_qualifications"))
    return Normalized(joined.drop(*parts), problems)


@register("json", "oracle")
def oracle(pages: DataFrame, ctx: Context) -> Normalized:
    items, problems = open_items(
        ctx, pages,
        "items ARRAY<STRUCT<requisitionList ARRAY<STRUCT<Id STRING, Title STRING, "
        "PrimaryLocation STRING, ShortDescriptionStr STRING, PostedDate STRING>>>>",
        lambda p: F.get(p["items"], F.lit(0))["requisitionList"],
    )
    once = _once(items, F.col("item.Id"))
    address = F.concat(F.lit("https://careers.oracle.com/jobs/#en/sites/jobsearch/job/"), F.col("key"))
    records = once.select(
        *KEEP,
        F.col("key").alias("source_job_id"),
        _t("Title").alias("title"),
        _t("PrimaryLocation").alias("location"),
        _t("ShortDescriptionStr").alias("description"),
        address.alias("application_url"),
        address.alias("source_url"),
        iso_prefix(F.col("item.PostedDate")).alias("date_posted"),
    )
    return Normalized(strip_html(records, "description"), problems)


@register("json", "salesforce")
def salesforce(pages: DataFrame, ctx: Context) -> Normalized:
    items, problems = open_items(
        ctx, pages,
        "jobs ARRAY<STRUCT<id STRING, jobId STRING, title STRING, name STRING, url STRING, "
        "applyUrl STRING, locations STRING, location STRING, department STRING, description STRING, "
        "postedDate STRING, datePosted STRING>>",
        lambda p: p["jobs"],
    )
    once = _once(items, first_filled(F.col("item.id"), F.col("item.jobId")))
    address = first_filled(F.col("item.url"), F.col("item.applyUrl"), F.col("careers_url"))
    places = F.when(_t("locations").isin("", "[]"), _t("location")).otherwise(_t("locations"))
    records = once.select(
        *KEEP,
        F.col("key").alias("source_job_id"),
        first_filled(F.col("item.title"), F.col("item.name")).alias("title"),
        as_text(places).alias("location"),
        _t("department").alias("department"),
        as_text(F.col("item.description"), " ").alias("description"),
        address.alias("application_url"),
        address.alias("source_url"),
        iso_prefix(first_filled(F.col("item.postedDate"), F.col("item.datePosted"))).alias("date_posted"),
    )
    return Normalized(strip_html(records, "description"), problems)


# What a mapping says of a record, beside the path of the record list.
_TEXTS = ["source_job_id", "title", "location", "country", "department", "employment_type"]
_PATHS = [*_TEXTS, "description", "date_posted", "url"]


def mapping_row(config: dict) -> tuple:
    """A configured mapping as one row: usable, path of the list, paths of the fields."""
    fields = config.get("fields") or {}
    usable = bool(fields.get("title")) and bool((config.get("request") or {}).get("url"))
    return (usable, config.get("jobs_path") or "", *[fields.get(name) or "" for name in _PATHS])


_MAPPING_SCHEMA = "STRUCT<usable: BOOLEAN, jobs_path: STRING, " + ", ".join(f"{n}: STRING" for n in _PATHS) + ">"


def with_mapping(pages: DataFrame, ctx: Context) -> DataFrame:
    """Pages with their source's `mapping`; `*` is the one of all sources without their own."""
    shared = F.struct(*[F.lit(v).alias(n) for n, v in zip(["usable", "jobs_path", *_PATHS], mapping_row(ctx.configs.get("*", {})))])
    named = [(n, mapping_row(c)) for n, c in ctx.configs.items() if c.get("request") and n != "*"]
    if not named:
        return pages.withColumn("mapping", shared)
    table = pages.sparkSession.createDataFrame(named, f"company STRING, own {_MAPPING_SCHEMA}")
    return pages.join(table, "company", "left").withColumn("mapping", F.coalesce("own", shared)).drop("own")


@register("json")
def generic(pages: DataFrame, ctx: Context) -> Normalized:
    """All configured JSON sources in one plan; a source without a mapping is a bad config.

    Mappings are data: a body is parsed once, whatever its mapping, and every row looks its
    fields up by the paths of its own source.
    """
    mapped = with_mapping(pages, ctx)

    def opened_by(payload: Column) -> Column:
        category = (
            F.when(~F.col("mapping.usable"), F.lit("invalid_config"))
            .when(payload.isNull(), F.lit("parse_error"))
            .otherwise(F.lit("structure_changed"))
        )
        return let(
            F.when(F.col("mapping.usable"), dig_list_by(payload, F.col("mapping.jobs_path"))),
            lambda found: opened_rows(found, category),
        )

    good, problems = split_opened(ctx, mapped, let(F.try_parse_json("body"), opened_by))
    item, path = F.col("item"), lambda name: F.col(f"mapping.{name}")
    records = good.select(
        *KEEP, F.col("url").alias("page_url"),
        *[dig_text_by(item, path(name)).alias(name) for name in _TEXTS],
        dig_text_by(item, path("description"), " ").alias("description"),
        iso_prefix(dig_text_by(item, path("date_posted"))).alias("date_posted"),
        F.when(F.startswith(path("url"), F.lit("http")), path("url")).alias("template"),
        dig_text_by(item, F.when(F.startswith(path("url"), F.lit("http")), F.lit("")).otherwise(path("url"))).alias("link"),
    )
    filled_in = F.replace(F.col("template"), F.lit("{source_job_id}"), F.col("source_job_id"))
    addressed = records.withColumn("application_url", F.coalesce(filled_in, F.col("link"))).withColumn(
        "source_url", first_filled(F.col("application_url"), F.col("page_url"))
    )
    key = first_filled(F.col("source_job_id"), record_fingerprint())
    once = _once(addressed.drop("page_url", "template", "link"), key).drop("key")
    return Normalized(strip_html(once, "description"), problems)
