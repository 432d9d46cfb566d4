"""HTML pages: embedded JSON-LD postings, selector-driven rows, detail texts."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.dates import iso_prefix
from ..functions.html import HIDDEN, strip_html
from ..functions.labels import lookup
from ..functions.slices import by_slices
from ..functions.text import first_filled, normalize_ws
from ..operators.enrich import enrich
from ..operators.gates import title_prefilter
from ..operators.identity import first_per_key
from .landing import Context, Normalized, detail_cap, explode_once, page_order, problem_rows, register

# Marks of a page that asks for a human.
CHALLENGE_MARKERS = ["captcha", "cf-challenge", "are you a robot", "access denied"]
_BLOCK = (
    r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"
)


# ---------------------------------------------------------------- JSON-LD
_NUMBERS = ("block", "pos")
_FIELDS = ("identifier", "title", "location", "country", "place_type", "employment_type", "description", "url", "direct", "posted")
_POSTING = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in _NUMBERS] + [T.StructField(n, T.StringType()) for n in _FIELDS]
)
_FOUND = T.StructType([T.StructField("readable", T.BooleanType()), T.StructField("postings", T.ArrayType(_POSTING))])
_FOUND_ARROW = pa.struct([
    ("readable", pa.bool_()),
    ("postings", pa.list_(pa.struct([(n, pa.int32()) for n in _NUMBERS] + [(n, pa.string()) for n in _FIELDS]))),
])


def _text(value) -> str:
    """A JSON value as a text; objects and lists as compact JSON."""
    if value is None or isinstance(value, str):
        return value or ""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _listed(value) -> list:
    """A field that is one value or a list of them."""
    return value if isinstance(value, list) else [] if value is None or value == "" else [value]


def _addresses(posting: dict) -> list:
    return [place.get("address") for place in _listed(posting.get("jobLocation")) if isinstance(place, dict)]


def posting_location(posting: dict) -> str:
    """Distinct 'locality, region' pieces (or plain addresses) in order."""
    pieces = []
    for address in _addresses(posting):
        if isinstance(address, dict):
            parts = (_text(address.get("addressLocality")), _text(address.get("addressRegion")))
            pieces.append(", ".join(p for p in parts if p))
        else:
            pieces.append(_text(address))
    return "; ".join(dict.fromkeys(p for p in pieces if p))


def posting_country(posting: dict) -> str:
    """First filled country, given as a text or as an object with a name."""
    raw = [a.get("addressCountry") for a in _addresses(posting) if isinstance(a, dict)]
    named = (_text(c.get("name") if isinstance(c, dict) else c) for c in raw)
    return next((c for c in named if c), "")


def _typed(posting: dict, block: int, pos: int) -> dict:
    ident = posting.get("identifier")
    kinds = _listed(posting.get("employmentType"))
    return {
        "block": block, "pos": pos,
        "identifier": _text(ident.get("value") if isinstance(ident, dict) else ident),
        "title": _text(posting.get("title")), "location": posting_location(posting), "country": posting_country(posting),
        "place_type": _text(posting.get("jobLocationType")), "employment_type": _text(kinds[0]) if kinds else "",
        "description": _text(posting.get("description")), "url": _text(posting.get("url")),
        "direct": _text(posting.get("directApply")), "posted": _text(posting.get("datePosted")),
    }


def _job_postings(block: str) -> list[dict]:
    """Every JobPosting object of a block, at any depth, in order."""
    found, todo = [], [json.loads(block)]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            kind = node.get("@type")
            if kind == "JobPosting" or (isinstance(kind, list) and "JobPosting" in kind):
                found.append(node)
            todo.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            todo.extend(reversed(node))
    return found


@arrow_udf(_FOUND)
def _postings(pages: pa.Array) -> pa.Array:
    """Per page, from its blocks: whether one could be read, and the postings of all that could."""

    def read(blocks) -> dict:
        readable, out = False, []
        for number, block in enumerate(blocks if blocks is not None else []):
            try:
                found = _job_postings(block or "")
            except (ValueError, RecursionError):
                continue
            readable = True
            out.extend(_typed(p, number, i) for i, p in enumerate(found))
        return {"readable": readable, "postings": out}

    return by_slices(read, _FOUND_ARROW, pages)


def with_postings(pages: DataFrame) -> DataFrame:
    """Pages with `found`: the typed postings of their blocks, parsed once."""
    return pages.withColumn("found", _postings(F.regexp_extract_all("body", F.lit(_BLOCK), F.lit(1))))


def jsonld_records(found: DataFrame, direct: bool = True) -> DataFrame:
    """One record per posting; without an address of its own, `direct` lets directApply stand in before the page."""
    links = [F.col("item.url"), F.col("item.direct")] if direct else [F.col("item.url")]
    each = explode_once(found.select("company", "source_type", "fetch_page", "url", F.col("found.postings").alias("items")))
    # Blocks come in page order and postings in block order.
    records = each.select(
        "company", "source_type", page_order(F.struct("item.block", "item.pos")).alias("fetch_ord"),
        F.col("item.identifier").alias("source_job_id"),
        "item.title", "item.location", "item.country",
        F.when(F.col("item.place_type") == "TELECOMMUTE", F.lit("remote")).otherwise(F.lit("")).alias("workplace_type"),
        "item.employment_type", "item.description",
        first_filled(*links, F.col("url")).alias("application_url"),
        F.col("url").alias("source_url"),
        iso_prefix(F.col("item.posted")).alias("date_posted"),
    )
    return strip_html(records, "description")


@register("jsonld")
def jsonld(pages: DataFrame, ctx: Context) -> Normalized:
    found = ctx.keep(with_postings(pages).select("company", "source_type", "fetch_page", "url", "found"), "blocks")
    # A source none of whose pages holds a readable block has changed; blocks
    # without any posting are an empty, healthy source.
    silent = (
        found.groupBy("company")
        .agg(F.max("found.readable").alias("any_block"), F.min("url").alias("url"))
        .where(~F.col("any_block"))
        .withColumn("category", F.lit("parse_error"))
    )
    return Normalized(jsonld_records(found), problem_rows(silent))


# ---------------------------------------------------------------- selectors
_STEP = re.compile(r"(?:[A-Za-z][\w-]*)?(?:\.[\w-]+)*")
_SELECTORS = ("row_selector", "title_selector", "location_selector", "date_selector", "detail_selector")


def unreadable_selector(config: dict) -> str:
    """The first selector of a configuration that is no chain of `tag`, `.class` and `tag.class` steps."""
    for name in _SELECTORS:
        text = str(config.get(name) or "")
        if not all(_STEP.fullmatch(part) for part in text.split()):
            return f"{name} {text}"
    return ""


def _unreadable(ctx: Context) -> Column:
    """Per source, the selector nobody can read; blank where all are fine.  Found when the plan is built."""
    shared = ctx.configs.get("*", {})
    table = {c: unreadable_selector({**shared, **config}) for c, config in ctx.configs.items() if c != "*"}
    fallback = F.lit(unreadable_selector(shared))
    return lookup(F.col("company"), table, fallback) if table else fallback


class _Selector:
    """A descendant chain of `tag`, `.class` and `tag.class` steps."""

    def __init__(self, text: str):
        steps = []
        for part in text.split():
            tag, *classes = part.split(".")
            steps.append((tag.lower(), set(classes)))
        self.steps = steps

    @staticmethod
    def _fits(step, element) -> bool:
        return (not step[0] or step[0] == element[0]) and step[1] <= element[1]

    def matches(self, path: list) -> bool:
        """Whether the innermost element of an open-element path is selected."""
        if not self.steps or not self._fits(self.steps[-1], path[-1]):
            return False
        left = len(self.steps) - 2
        for element in reversed(path[:-1]):
            if left < 0:
                break
            if self._fits(self.steps[left], element):
                left -= 1
        return left < 0


_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)


class _RowReader(HTMLParser):
    """Collects, per matched row, the first element of each cell selector."""

    def __init__(self, row: str, cells: dict[str, str]):
        super().__init__(convert_charrefs=True)
        self.row = _Selector(row)
        self.cells = {name: _Selector(text) for name, text in cells.items() if text}
        self.path: list = []
        self.rows: list[dict] = []
        self.open_rows: list[tuple[int, dict]] = []
        self.captures: list[tuple[int, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        attributes = dict(attrs)
        self.path.append((tag, set((attributes.get("class") or "").split())))
        depth = len(self.path)
        for name, selector in self.cells.items():
            if selector.matches(self.path):
                for _, found in self.open_rows:
                    if name not in found:
                        pieces: list[str] = []
                        found[name] = (pieces, attributes.get("href") or "")
                        self.captures.append((depth, pieces))
        if self.row.matches(self.path):
            found = {}
            self.rows.append(found)
            self.open_rows.append((depth, found))
        if tag in _VOID:
            self._leave(depth - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._leave(len(self.path) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.path), 0, -1):
            if self.path[depth - 1][0] == tag:
                self._leave(depth - 1)
                break

    def handle_data(self, data):
        if not any(element[0] in HIDDEN for element in self.path):
            for _, pieces in self.captures:
                pieces.append(data)

    def _leave(self, depth: int) -> None:
        del self.path[depth:]
        self.open_rows = [r for r in self.open_rows if r[0] <= depth]
        self.captures = [c for c in self.captures if c[0] <= depth]


_CELLS = ("title", "link", "location", "date")
_ROW_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in _CELLS]))
_ROW_ARROW = pa.list_(pa.struct([(n, pa.string()) for n in _CELLS]))


@arrow_udf(_ROW_TYPE)
def _read_rows(
    body: pa.Array, base: pa.Array, row: pa.Array, title: pa.Array,
    location: pa.Array, date: pa.Array,
) -> pa.Array:
    """Rows of each page by its source's selectors; empty when none matched."""

    def read(page, address, row_sel, title_sel, location_sel, date_sel):
        if page is None:
            return []
        cells = {"title": title_sel, "location": location_sel, "date": date_sel}
        reader = _RowReader(row_sel, cells)
        reader.feed(page)
        reader.close()
        out = []
        for found in reader.rows:
            text = {n: " ".join(found[n][0]) if n in found else None for n in cells}
            href = found["title"][1] if "title" in found else ""
            out.append(
                {
                    "title": text["title"],
                    "link": urljoin(address, href) if href else None,
                    "location": text["location"],
                    "date": text["date"],
                }
            )
        return out

    return by_slices(read, _ROW_ARROW, body, base, row, title, location, date)


@arrow_udf(T.StringType())
def _read_element(body: pa.Array, selector: pa.Array) -> pa.Array:
    """Text of the first element a selector picks, NULL when there is none."""

    def read(page, wanted):
        if page is None:
            return None
        reader = _RowReader(wanted, {})
        reader.cells = {"text": _Selector(wanted)}
        found: dict = {}
        reader.open_rows = [(0, found)]
        reader.feed(page)
        reader.close()
        return " ".join(found["text"][0]) if "text" in found else None

    return by_slices(read, pa.string(), body, selector)


def _setting(ctx: Context, name: str, default: str = "") -> Column:
    """A source's configured value; `*` configures sources without their own."""
    table = {c: str(cfg[name]) for c, cfg in ctx.configs.items() if cfg.get(name) is not None}
    fallback = F.lit(table.pop("*", default))
    return lookup(F.col("company"), table, fallback) if table else fallback


def read_rows(pages: DataFrame, ctx: Context, landed: bool = True) -> DataFrame:
    """Pages with an array column `rows`, read by each source's selectors.

    Rendered pages (`landed=False`) have neither a link prefix nor a date selector.
    """
    base = first_filled(_setting(ctx, "url_prefix"), F.col("url")) if landed else F.col("url")
    return pages.withColumn(
        "rows",
        _read_rows(
            "body", base, _setting(ctx, "row_selector"), _setting(ctx, "title_selector"),
            _setting(ctx, "location_selector"), _setting(ctx, "date_selector") if landed else F.lit(""),
        ),
    )


def selector_records(read: DataFrame) -> DataFrame:
    rows = explode_once(
        read.select("company", "source_type", "fetch_page", "url", F.col("rows").alias("items"))
    ).where("item.title IS NOT NULL")
    return rows.select(
        "company", "source_type", page_order().alias("fetch_ord"),
        normalize_ws(F.col("item.title")).alias("title"),
        normalize_ws(F.col("item.location")).alias("location"),
        first_filled(F.col("item.link"), F.col("url")).alias("application_url"),
        F.col("url").alias("source_url"),
        iso_prefix(normalize_ws(F.col("item.date"))).alias("date_posted"),
    )


def with_page_details(records: DataFrame, ctx: Context) -> DataFrame:
    """Description from the landed posting page, keyed by its address."""
    if ctx.details is None:
        return records
    listing = records.withColumn("detail_key", F.col("application_url"))
    wanted = title_prefilter(F.col("title"), ctx.pack) & (
        _setting(ctx, "fetch_details", "True") != "False"
    )
    joined = enrich(listing, ctx.details, wanted, ["fetch_ord"], "detail_key", detail_cap(ctx))
    selector = _setting(ctx, "detail_selector", "body")
    return joined.withColumn(
        "description", element_text(F.col("detail.body"), selector)
    ).drop("detail", "detail_key")


def element_text(body: Column, selector: Column, limit: int | None = None) -> Column:
    """Text of the first selected element, normalised; whole unless a limit is given."""
    text = normalize_ws(_read_element(body, selector))
    return text if limit is None else F.left(text, F.lit(limit))


@register("html")
def html_rows(pages: DataFrame, ctx: Context) -> Normalized:
    bad = _unreadable(ctx)
    usable = (
        (F.trim("source_identifier") != "") & (bad == "")
        & (_setting(ctx, "row_selector") != "") & (_setting(ctx, "title_selector") != "")
    )
    read = read_rows(pages.withColumn("body", F.when(usable, F.col("body"))).withColumn("no_body", F.col("body").isNull()), ctx)
    category = F.when(~usable, F.lit("invalid_config")).when(F.col("no_body"), F.lit("parse_error")).when(
        (F.col("page_no") == 0) & (F.size("rows") == 0), F.lit("structure_changed")
    )
    checked = ctx.keep(
        read.select("company", "source_type", "fetch_page", "url", "rows", category.alias("category"), bad.alias("note")), "rows"
    )
    once = first_per_key(
        selector_records(checked.where("category IS NULL")), ["company", "application_url"], ["fetch_ord"]
    )
    return Normalized(with_page_details(once, ctx), problem_rows(checked))


@register("playwright")
def rendered(pages: DataFrame, ctx: Context) -> Normalized:
    """Landed rendered pages: challenge check, JSON-LD first, selectors second; one read of each page."""
    low = F.lower("body")
    challenged = F.coalesce(
        F.exists(F.array(*[F.lit(m) for m in CHALLENGE_MARKERS]), lambda m: F.contains(low, m)), F.lit(False)
    )
    bad = _unreadable(ctx)
    usable = (_setting(ctx, "row_selector") != "") & (_setting(ctx, "title_selector") != "") & (bad == "")
    asked = pages.withColumn("challenged", challenged).withColumn("no_body", F.col("body").isNull())
    found = with_postings(asked.withColumn("body", F.when(~F.col("challenged"), F.col("body"))))
    # Pages without a posting are read by selectors; the others hand the reader no body.
    plain = ~F.col("challenged") & ~F.col("no_body") & (F.size("found.postings") == 0)
    read = read_rows(
        found.withColumn("plain", plain).withColumn("body", F.when(F.col("plain") & usable, F.col("body"))), ctx, landed=False
    )
    category = (
        F.when(F.col("challenged"), F.lit("blocked")).when(F.col("no_body"), F.lit("parse_error"))
        .when(F.col("plain") & ~usable, F.lit("invalid_config"))
    )
    note = F.when(F.col("plain"), bad).otherwise(F.lit(""))
    checked = ctx.keep(
        read.select("company", "source_type", "fetch_page", "url", "found", "rows", category.alias("category"), note.alias("note")),
        "rows",
    )
    fine = checked.where("category IS NULL")
    kept = jsonld_records(fine, direct=False).select(
        "company", "source_type", "fetch_ord", "title", "description", "application_url", "source_url", "date_posted"
    )
    return Normalized(kept.unionByName(selector_records(fine), allowMissingColumns=True), problem_rows(checked))
