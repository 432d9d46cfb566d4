"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, literals, strip_ws, text_or_empty

# Query keys that only track where a visitor came from.
TRACKING_KEYS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gh_src", "lever-source", "source", "src", "ref", "referrer",
]
# RFC 3986 appendix B: scheme, authority, path, query; the fragment is dropped.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
# Schemes whose last path segment may carry `;parameters`.
_PARAM_SCHEMES = ["", "http", "https", "ftp", "sftp"]


def form_decode(value: Column) -> Column:
    """Decode a form-encoded text; a stray percent sign stays as it is."""
    return F.try_url_decode(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"))


def form_encode(value: Column) -> Column:
    out = F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%7E"), F.lit("~"))


def _clean_query(query: Column) -> Column:
    """Drop tracking keys and blank values, keep order, encode again."""
    raw = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    pairs = F.transform(
        raw,
        lambda p: F.struct(
            form_decode(F.substring_index(p, "=", 1)).alias("key"),
            form_decode(F.regexp_replace(p, "(?s)^[^=]*=", "")).alias("value"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.array_contains(literals(TRACKING_KEYS), F.lower(p["key"])))
    return F.array_join(
        F.transform(kept, lambda p: F.concat(form_encode(p["key"]), F.lit("="), form_encode(p["value"]))),
        "&",
    )


def canonical_url(url: Column) -> Column:
    """One spelling per address: what a posting's URL is compared by."""

    # Each stage binds its parts once; the next stage only refers to them.
    def split(u: Column) -> Column:
        part = lambda i: F.regexp_extract(u, _PARTS, i)
        return F.struct(
            F.lower(part(1)).alias("scheme"), F.lower(part(2)).alias("host"),
            part(3).alias("path"), part(4).alias("query"),
        )

    def clean(p: Column) -> Column:
        bare = F.when(
            p["scheme"].isin(_PARAM_SCHEMES), F.regexp_replace(p["path"], ";[^/]*$", "")
        ).otherwise(p["path"])
        return F.struct(
            F.when(p["scheme"] == "", F.lit("https")).otherwise(p["scheme"]).alias("scheme"),
            p["host"].alias("host"),
            F.rtrim(bare, F.lit("/")).alias("path"),
            F.when(p["query"] == "", F.lit("")).otherwise(_clean_query(p["query"])).alias("query"),
        )

    def build(p: Column) -> Column:
        rooted = F.startswith(p["path"], F.lit("/")) | (p["path"] == "")
        return F.concat(
            p["scheme"],
            F.when((p["host"] != "") | rooted, F.lit("://")).otherwise(F.lit(":")),
            p["host"],
            F.when((p["host"] != "") & ~rooted, F.lit("/")).otherwise(F.lit("")),
            p["path"],
            F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p["query"])),
        )

    # Tabs and line breaks inside an address carry no meaning.
    cleaned = F.translate(strip_ws(text_or_empty(url)), "\t\r\n", "")
    return F.when(text_or_empty(url) == "", F.lit("")).otherwise(
        let(let(let(cleaned, split), clean), build)
    )


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve a link against a page address: the four common link shapes.

    Dot segments (`../`) are rare in feeds; the page parser resolves those.
    """
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(base, r"(?s)[?#].*$", "")
    folder = F.when(bare == site, F.concat(site, F.lit("/"))).otherwise(
        F.regexp_replace(bare, r"[^/]*$", "")
    )
    return (
        F.when(text_or_empty(href) == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(site, href))
        .when(F.startswith(href, F.lit("?")), F.concat(bare, href))
        .when(
            F.startswith(href, F.lit("#")),
            F.concat(F.regexp_replace(base, r"(?s)#.*$", ""), href),
        )
        .otherwise(F.concat(folder, href))
    )
