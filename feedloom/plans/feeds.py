"""Catalogue queries over landed payloads, which Spark builds from documents.

Every page holds the document's posting and a second item: a later copy with
the same id (first wins), an unlisted one, or one from another place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import strip_html
from ..session import scratch_path, written
from ..sources import boards, endpoints, pages
from ..sources.landing import Context, land, normalize, source_pages
from ..sources.state import load_records
from . import views
from .catalog import PACK, query
from .run import keep_in, run_once
from .views import FETCH_TS, SECOND_TS, run_ts, table

COLUMNS = ["company", "source_job_id", "title", "location", "country", "department",
           "employment_type", "description", "requirements", "application_url", "date_posted"]


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in COLUMNS])


def _run(docs: DataFrame, source_type: str, preset: str, identifier: str, body: Column,
         normalizer, details: DataFrame | None = None, configs: dict | None = None) -> DataFrame:
    sources = views.feed_sources(docs, source_type, identifier)
    ctx = Context(sources, run_ts(FETCH_TS), details, PACK, configs or {})
    landed = views.landed(docs, source_type, preset, body)
    return _shown(normalizer(source_pages(landed, sources), ctx).records)


def _item(**fields: Column | str) -> Column:
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])


def _object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _cols() -> dict[str, Column]:
    return {c: F.col(c) for c in ("id", "title", "markup", "needs", "lang", "epoch", "company")}


def _greenhouse_body(c: dict[str, Column]) -> Column:
    def item(ident: Column, title: Column, content: Column) -> Column:
        return _item(
            id=ident, title=title, updated_at="2026-07-01T12:00:00-04:00",
            first_published=F.when(c["lang"] != "fr", F.lit("2026-06-28T09:00:00-04:00")),
            absolute_url=F.concat(F.lit("https://boards.example.com/"), ident),
            location=_item(name=c["lang"]),
            departments=F.array(_item(name="Engineering"), _item(name=""), _item(name=c["lang"])),
            content=content,
        )

    # Board content is escaped markup inside JSON.
    return _object(jobs=F.array(
        item(c["id"], c["title"], views._escape(c["markup"])),
        item(F.concat(c["id"], F.lit("-b")), F.lit("Second"), F.lit("no &amp; tags")),
    ))


@query
def normalize_greenhouse(spark, folder):
    docs = views.feed_docs(spark, folder)
    return _run(docs, "greenhouse", "", "board", _greenhouse_body(_cols()), boards.greenhouse)


def _lever_body(c: dict[str, Column]) -> Column:
    item = _item(
        id=c["id"], text=c["title"], createdAt=c["epoch"] * 1000,
        hostedUrl=F.concat(F.lit("https://l.example.com/"), c["id"]),
        applyUrl=F.when(c["lang"] == "en", F.concat(F.lit("https://l.example.com/apply/"), c["id"])),
        categories=_item(commitment="Full-time", location=c["lang"], team="Core"),
        country="US", workplaceType="Hybrid",
        descriptionPlain=F.when(c["lang"] == "de", F.lit("Plain text.")), description=c["markup"],
        lists=F.array(
            _item(text="Requirements", content=c["needs"]),
            _item(text="Benefits", content="<li>snacks</li>"),
            _item(text="Basic Qualifications", content="<li>care</li>"),
        ),
    )
    return F.to_json(F.array(item))


@query
def normalize_lever(spark, folder):
    return _run(views.feed_docs(spark, folder), "lever", "", "site", _lever_body(_cols()), boards.lever)


@query
def normalize_ashby(spark, folder):
    docs, c = views.feed_docs(spark, folder), _cols()

    def item(listed: Column) -> Column:
        return _item(
            id=c["id"], title=c["title"], location=c["lang"],
            secondaryLocations=F.array(_item(location="New York, NY"), _item(location="")),
            department=F.when(c["lang"] == "en", F.lit("Product")).otherwise(F.lit("")), team="Growth",
            employmentType="FullTime", isListed=listed, isRemote=F.lit(True),
            publishedAt="2026-07-05T00:00:00.000Z", jobUrl=F.concat(F.lit("https://a.example.com/"), c["id"]),
            descriptionHtml=c["markup"], descriptionPlain="plain",
        )

    known = F.when(c["lang"] != "fr", F.lit(True))
    body = _object(jobs=F.array(item(known), item(F.lit(False))))
    return _run(docs, "ashby", "", "org", body, boards.ashby)


@query
def normalize_workday(spark, folder):
    docs, c = views.feed_docs(spark, folder), _cols()
    path = F.concat(F.lit("/job/"), c["lang"], F.lit("/R-"), c["id"])

    def item(title: Column) -> Column:
        return _item(
            title=title, externalPath=path, locationsText=c["lang"], postedOn="Posted 3 Days Ago",
            bulletFields=F.when(c["lang"] == "en", F.array(F.concat(F.lit("JR"), c["id"]))).otherwise(F.array().cast("array<string>")),
        )

    info = _item(
        jobDescription=c["markup"], timeType="Full time",
        location=F.when(c["lang"] == "en", F.lit("Austin, TX")).otherwise(F.lit("")),
        country=_item(descriptor="United States of America"), postedOn="Posted Yesterday",
        externalUrl=F.when(c["lang"] == "de", F.concat(F.lit("https://w.example.com/"), c["id"])),
    )
    details = views.feed_details(
        spark, folder, docs.withColumn("detail_key", path), _object(jobPostingInfo=info)
    )
    body = _object(jobPostings=F.array(item(c["title"]), item(F.lit("Later copy"))))
    return _run(docs, "workday", "", "w.example.com/acme/Careers", body, boards.workday, details)


@query
def normalize_eightfold(spark, folder):
    docs, c = views.feed_docs(spark, folder), _cols()

    def item(title: Column) -> Column:
        return _item(
            id=c["id"], displayJobId=F.when(c["lang"] == "en", F.concat(F.lit("D"), c["id"])), name=title,
            locations=F.when(c["lang"] == "fr", F.array().cast("array<string>")).otherwise(F.array(c["lang"], F.lit("Remote"))),
            standardizedLocations=F.array(F.lit("Paris")),
            postedTs=F.when(c["lang"] != "es", c["epoch"]).otherwise(F.lit(0)), creationTs=F.lit(1700000000),
            department="Software", workLocationOption="onsite",
            positionUrl=F.when(c["lang"] == "de", F.concat(F.lit("/p/"), c["id"])),
        )

    info = _item(
        jobDescription=c["markup"], efcustomTextEmploymentType=F.array(F.lit("Full-Time"), F.lit("x")),
        location=F.when(c["lang"] == "en", F.lit("Redmond")),
        publicUrl=F.when(c["lang"] == "en", F.concat(F.lit("https://e.example.com/"), c["id"])),
    )
    details = views.feed_details(spark, folder, docs.withColumn("detail_key", c["id"]), _object(data=info))
    body = _object(
        status=F.lit(200), data=F.struct(F.array(item(c["title"]), item(F.lit("Later copy"))).alias("positions"))
    )
    return _run(docs, "eightfold", "", "e.example.com/example.com", body, boards.eightfold, details)


@query
def normalize_amazon(spark, folder):
    docs, c = views.feed_docs(spark, folder), _cols()

    def item(title: Column) -> Column:
        return _item(
            id_icims=F.when(c["lang"] == "en", F.concat(F.lit("I"), c["id"])), id=c["id"],
            job_path=F.concat(F.lit("/en/jobs/"), c["id"]), title=title, location=c["lang"],
            job_category="Software", job_schedule_type="full-time", description=c["markup"],
            basic_qualifications=c["needs"], preferred_qualifications="", posted_date="July 5, 2026",
        )

    body = _object(jobs=F.array(item(c["title"]), item(F.lit("Later copy"))))
    return _run(docs, "json", "amazon", "amazon", body, endpoints.amazon)


@query
def normalize_google(spark, folder):
    docs, c = views.feed_docs(spark, folder), _cols()

    def item(title: Column) -> Column:
        return _item(
            id=F.concat(F.lit("jobs/"), c["id"]), title=title,
            locations=F.array(_item(display=c["lang"]), _item(display="Boston")),
            description=c["markup"], summary="<i>short</i>", qualifications=c["needs"],
            created="2026-06-30T00:00:00Z",
        )

    body = _object(jobs=F.array(item(c["title"]), item(F.lit("Later copy"))))
    return _run(docs, "json", "google", "google", body, endpoints.google)


@query
def normalize_uber(spark, folder):
    docs, c = views.feed_docs(spark, folder), _cols()
    place = lambda city, region, country: _item(city=city, region=region, country=country)

    def item(title: Column) -> Column:
        return _item(
            id=c["id"], title=title, department="Eng", description=c["markup"], creationDate="2026-06-29T10:00:00Z",
            location=place(c["lang"], F.lit("CA"), F.lit("USA")),
            allLocations=F.when(
                c["lang"] == "en",
                F.array(place(F.lit("Seattle"), F.lit("WA"), F.lit("USA")), place(F.lit("Paris"), F.lit(""), F.lit("FRA")),
                        place(F.lit("Reno"), F.lit(""), F.lit("USA"))),
            ),
        )

    body = _object(data=F.struct(F.array(item(c["title"]), item(F.lit("Later copy"))).alias("results")))
    return _run(docs, "json", "uber", "uber", body, endpoints.uber)


@query
def normalize_janestreet(spark, folder):
    docs, c = views.feed_docs(spark, folder), _cols()

    def item(city: str) -> Column:
        return _item(
            id=c["id"], position=F.when(c["lang"] == "en", c["title"]), title=F.concat(F.lit("T "), c["title"]),
            city=city, team="Tech", type="Full-Time", overview=c["markup"],
        )

    body = F.to_json(F.array(item("New York"), item("London")))
    return _run(docs, "json", "janestreet", "janestreet", body, endpoints.janestreet)


@query
def normalize_smartrecruiters(spark, folder):
    docs, c = views.feed_docs(spark, folder), _cols()

    def item(title: Column, country: str) -> Column:
        return _item(
            id=c["id"], name=title, ref=F.when(c["lang"] != "fr", F.lit("https://s.example.com/ref")),
            releasedDate="2026-07-02T08:00:00Z", location=_item(city=c["lang"], region="TX", country=country),
            function=_item(label="IT"), typeOfEmployment=_item(label="Permanent"),
        )

    section = lambda text: _item(text=text)
    info = _item(sections=_item(
        companyDescription=section("<p>About us</p>"), jobDescription=section(c["markup"]),
        qualifications=section(c["needs"]),
    ))
    details = views.feed_details(spark, folder, docs.withColumn("detail_key", c["id"]), _object(jobAd=info))
    body = _object(content=F.array(
        item(F.lit("Abroad"), "de"), item(c["title"], "us"), item(F.lit("Later copy"), "")
    ))
    return _run(docs, "json", "smartrecruiters", "smartrecruiters:acme", body, endpoints.smartrecruiters, details)


@query
def normalize_oracle(spark, folder):
    docs, c = views.feed_docs(spark, folder), _cols()

    def item(title: Column) -> Column:
        return _item(Id=c["id"], Title=title, PrimaryLocation=c["lang"], ShortDescriptionStr=c["markup"], PostedDate="2026-07-03")

    inner = F.array(F.struct(F.array(item(c["title"]), item(F.lit("Later copy"))).alias("requisitionList")))
    return _run(docs, "json", "oracle", "oracle", _object(items=inner), endpoints.oracle)


@query
def normalize_salesforce(spark, folder):
    docs, c = views.feed_docs(spark, folder), _cols()

    def item(name: Column) -> Column:
        return _item(
            id=F.when(c["lang"] == "en", c["id"]), jobId=F.concat(F.lit("J"), c["id"]), name=name,
            url=F.when(c["lang"] == "de", F.concat(F.lit("https://s.example.com/"), c["id"])),
            locations=F.array(c["lang"], F.lit("Remote")), department="Sales", description=c["markup"],
            datePosted="2026-07-04T00:00:00Z",
        )

    body = _object(jobs=F.array(item(c["title"]), item(F.lit("Later copy"))))
    return _run(docs, "json", "salesforce", "salesforce", body, endpoints.salesforce)


# One mapping as it would stand in a configuration file.
MAPPING = {
    "request": {"url": "https://api.example.com/jobs?page={page}"},
    "jobs_path": "result.openings",
    "fields": {
        "source_job_id": "req", "title": "name", "location": "sites.city", "description": "desc",
        "date_posted": "posted", "department": "path.0.label",
        "url": "https://api.example.com/apply/{source_job_id}",
    },
}


def _mapped_body(c: dict[str, Column]) -> Column:
    def item(name: Column) -> Column:
        return _item(
            req=F.concat(F.lit("R-"), c["id"]), name=name, desc=c["markup"], posted="2026-07-01T00:00:00Z",
            sites=F.array(_item(city=c["lang"]), _item(city="Denver")), path=F.array(_item(label="Ops"), _item(label="x")),
        )

    return _object(result=F.struct(F.array(item(c["title"]), item(F.lit("Later copy"))).alias("openings")))


@query
def normalize_generic(spark, folder):
    docs = views.feed_docs(spark, folder)
    return _run(docs, "json", "", "", _mapped_body(_cols()), endpoints.generic, configs={"*": MAPPING})


#: Another mapping, of some sources only.
OWN_MAPPING = {
    "request": {"url": "https://own.example.com"}, "jobs_path": "0.rows",
    "fields": {"source_job_id": "key", "title": "names.en", "location": "where.1", "description": "body", "url": "link"},
}


def _own_body(c: dict[str, Column]) -> Column:
    row = _item(
        key=c["id"], names=_item(en=c["title"]), where=F.array(F.lit("nowhere"), c["lang"]), body=c["markup"],
        link=F.concat(F.lit("https://own.example.com/"), c["id"]),
    )
    return F.to_json(F.array(F.struct(F.array(row).alias("rows"))))


def _kind_no(name: Column) -> Column:
    return F.regexp_extract(name, "([0-9]+)$", 1).cast("int") % 6


@query
def normalize_mixed(spark, folder):
    """One landing table with boards, mappings, cut and refused pages: records, and how many pages have which problem."""
    docs, c = views.feed_docs(spark, folder), _cols()
    no, cut = _kind_no(F.col("company")), F.concat(F.lit('{"jobs": ['), F.col("id"))
    body = (
        F.when((no == 4) & (F.col("lang") == "de"), cut).when(no.isin(0, 4), _greenhouse_body(c))
        .when(no.isin(1, 5), _lever_body(c)).when(no == 2, _mapped_body(c)).otherwise(_own_body(c))
    )
    refused = (no == 5) & (F.col("lang") == "es")
    landed = views.landed(docs.withColumn("refused", refused), "", "", body, F.col("refused"))
    of = _kind_no(F.col("name"))
    typed = F.when(of.isin(0, 4), F.lit("greenhouse")).when(of.isin(1, 5), F.lit("lever")).otherwise(F.lit("json"))
    sources = views.feed_sources(docs, "", "board").withColumns(
        {"source_type": typed, "source_identifier": F.when(typed == "json", F.lit("")).otherwise(F.lit("board"))}
    )
    own = {f"src{n}": OWN_MAPPING for n in range(3, 60, 6)}
    steps = scratch_path(spark, "mixed")
    ctx = Context(sources, run_ts(FETCH_TS), pack=PACK, configs={**own, "*": MAPPING}, keep=keep_in(steps))
    found = normalize(land(landed, sources, f"{steps}/landing"), ctx)
    counted = found.problems.groupBy("company", "category").agg(F.count(F.lit(1)).cast("string").alias("source_job_id"))
    shown = _shown(found.records).na.fill("").withColumn("category", F.lit(""))
    blank = [F.lit("").alias(c) for c in COLUMNS if c not in counted.columns]
    return shown.unionByName(counted.select("*", *blank))


# ------------------------------------------------------------------ whole runs
def _landed_board(docs: DataFrame, refused: Column) -> DataFrame:
    return views.landed(docs.withColumn("refused", refused), "greenhouse", "", _greenhouse_body(_cols()), F.col("refused"))


def whole_runs(spark, folder, runs: int) -> DataFrame:
    """The state after one or two whole runs: landed pages -> records -> gates -> score -> merge -> outputs.

    The digest of the first run is delivered.  The second run finds two thirds of the postings, and one source refuses.
    """
    docs, root = views.feed_docs(spark, folder), scratch_path(spark, "runs")
    sources = views.feed_sources(docs, "greenhouse", "board")
    run_once(_landed_board(docs, F.lit(False)), sources, f"{root}/0", f"{root}/1", run_ts(FETCH_TS), pack=PACK,
             deliver=lambda digest: True)
    if runs == 2:
        later = _landed_board(docs.where(F.col("doc_id") % 3 != 0), F.col("company") == "src4")
        run_once(later, sources, f"{root}/1", f"{root}/2", run_ts(SECOND_TS), pack=PACK)
    rows = spark.read.parquet(f"{root}/{runs}/state").where("lifecycle <> 'closed'")
    saved = load_records(spark, f"{root}/{runs}/active").unionByName(load_records(spark, f"{root}/{runs}/archived"))
    shown = ["job_id", "title", "overall_score", "sponsorship_classification", "disqualified", "first_seen", "last_seen",
             "status", "consecutive_missing", "announced"]
    return saved.join(rows.select("job_id", "lifecycle", "matched_by"), "job_id", "left").select(*shown, "lifecycle", "matched_by")


@query
def full_run_state(spark, folder):
    return whole_runs(spark, folder, 1)


@query
def second_run_state(spark, folder):
    return whole_runs(spark, folder, 2)


@query
def landed_problems(spark, folder):
    """Structure checks: good, cut, changed and refused pages, by language."""
    docs, c = views.feed_docs(spark, folder), _cols()
    good = _object(jobs=F.array(_item(id=c["id"], title=c["title"])))
    body = (
        F.when(c["lang"] == "en", good)
        .when(c["lang"] == "de", F.concat(F.lit('{"jobs": ['), c["id"]))
        .when(c["lang"] == "fr", F.lit('{"unexpected": []}'))
    )
    refused = F.when(c["lang"] == "es", F.lit('{"error_category": "blocked", "error_message": "refused"}'))
    landed = views.landed(docs, "greenhouse", "", body).drop("context_json")
    flagged = landed.join(docs.select(F.col("doc_id").alias("page_no"), refused.alias("context_json")), "page_no")
    # One source has a type nobody registered.
    odd = F.when(F.col("name") == "src9", F.lit("carrier")).otherwise(F.col("source_type"))
    sources = views.feed_sources(docs, "greenhouse", "board").withColumn("source_type", odd)
    found = normalize(flagged, Context(sources, run_ts(FETCH_TS), pack=PACK))
    return found.problems.groupBy("company", "category").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------- pages
@query
def page_text(spark, folder):
    return strip_html(table(spark, folder, "pages").select("page_id", "html"), "html").select(
        "page_id", F.col("html").alias("text")
    )


@query
def page_articles(spark, folder):
    found = table(spark, folder, "pages")
    return found.select("page_id", pages.element_text(F.col("html"), F.lit("article")).alias("text"))


def _page_sources(feed: DataFrame, source_type: str) -> DataFrame:
    hosts = feed.select(F.col("company").alias("name")).distinct()
    return written(hosts.select(
        F.lit(0).alias("source_no"), "name", F.lit(True).alias("enabled"), F.lit(1).alias("priority"),
        F.lit("").alias("careers_url"), F.lit(source_type).alias("source_type"),
        F.lit("https://example.com/jobs").alias("source_identifier"),
        F.array().cast("array<string>").alias("locations"), F.lit("").alias("notes"),
    ), "sources")


def _page_context(feed: DataFrame, source_type: str) -> tuple[DataFrame, Context]:
    sources = _page_sources(feed, source_type)
    landed = views.landed(feed, source_type, "", F.col("html")).drop("url")
    urls = feed.select(F.col("doc_id").alias("page_no"), "url")
    return landed.join(urls, "page_no"), Context(sources, run_ts(FETCH_TS), pack=PACK)


SELECTORS = {"row_selector": "nav ul li", "title_selector": "li a"}


@query
def page_rows(spark, folder):
    """Navigation links as a listing: rows by selectors, first wins by link."""
    feed = views.page_feed(spark, folder)
    landed, ctx = _page_context(feed, "html")
    shared = Context(ctx.sources, ctx.run_ts, None, PACK, {"*": SELECTORS})
    rows = pages.html_rows(source_pages(landed, ctx.sources), shared).records
    return rows.select("company", "title", "application_url")


@query
def page_detail_rows(spark, folder):
    """Listing pages with the text of each posting's own page, which exists for labelled documents."""
    docs, c = views.feed_docs(spark, folder), _cols()
    path = F.concat(F.lit("/p/"), c["id"])
    listing = F.concat(F.lit('<ul><li class="job"><a href="'), path, F.lit('">'), views._escape(c["title"]), F.lit("</a></li></ul>"))
    own_page = F.concat(F.lit("<html><body><nav>Menu</nav><main>"), c["markup"], F.lit("</main></body></html>"))
    details = views.feed_details(
        spark, folder, docs.withColumn("detail_key", F.concat(F.lit("https://feeds.example.com"), path)), own_page
    )
    selectors = {"row_selector": "li.job", "title_selector": "a", "detail_selector": "main"}
    return _run(docs, "html", "", "https://feeds.example.com", listing, pages.html_rows, details, {"*": selectors})


def _jsonld_page(c: dict[str, Column]) -> Column:
    address = F.struct(
        F.lit("PostalAddress").alias("@type"), F.lit("Boston").alias("addressLocality"),
        F.lit("MA").alias("addressRegion"), _item(name=c["lang"]).alias("addressCountry"),
    )
    posting = F.struct(
        F.lit("JobPosting").alias("@type"), c["title"].alias("title"), F.lit("2026-07-06").alias("datePosted"),
        _item(value=F.concat(F.lit("REQ-"), c["id"])).alias("identifier"),
        F.array(F.lit("FULL_TIME"), F.lit("X")).alias("employmentType"),
        F.array(_item(address=address), _item(address=address)).alias("jobLocation"),
        F.when(c["lang"] == "en", F.lit("TELECOMMUTE")).alias("jobLocationType"),
        c["markup"].alias("description"),
        F.when(c["lang"] != "fr", F.concat(F.lit("https://j.example.com/"), c["id"])).alias("url"),
    )
    other = F.struct(F.lit("WebPage").alias("@type"), F.lit("no posting").alias("title"))
    graph = F.to_json(F.struct(F.array(_item(inner=F.array(posting))).alias("@graph"), other.alias("page")))
    return F.concat(
        F.lit("<html><head><script>var x = 1;</script><script type=\"application/ld+json\">{broken</script>"
              "<script type=\"application/ld+json\">"),
        graph, F.lit("</script></head><body><p>Rendered.</p></body></html>"),
    )


@query
def page_jsonld(spark, folder):
    docs = views.feed_docs(spark, folder)
    return _run(docs, "jsonld", "", "https://j.example.com", _jsonld_page(_cols()), pages.jsonld)


@query
def rendered_rows(spark, folder):
    """Rendered pages: those of one kind of host met a challenge; others give rows."""
    feed = views.page_feed(spark, folder).withColumn(
        "html", F.when(F.contains("url", F.lit("casino")), F.concat(F.col("html"), F.lit("<p>Access Denied</p>"))).otherwise(F.col("html"))
    )
    landed, ctx = _page_context(feed, "playwright")
    shared = Context(ctx.sources, ctx.run_ts, None, PACK, {"*": SELECTORS})
    found = pages.rendered(source_pages(landed, ctx.sources), shared)
    return found.accepted().select("company", "title", "application_url")
