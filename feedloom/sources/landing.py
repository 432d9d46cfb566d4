"""From landed payload pages to records: checks, registry and dispatch.

Landing table: one row per fetched page (`schema.LANDING_SCHEMA`), best kept
partitioned by the day of `fetched_at`, so a run reads its own pages only, and by
`kind` (`land`), so a normaliser reads its own pages only.

Every step that two parts of a run need goes through the context's `keep`: pages
by kind, and per kind the opened pages, which hold items or a category.  With a `keep`
that writes, the landing table is read once and a body is parsed once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import lookup
from ..functions.text import let, text_or_empty
from ..operators.gates import skipped_source
from ..operators.identity import Cap
from ..rules import POSTING, RulePack

PROBLEM_COLUMNS = ["company", "category", "message"]
PAGE_COLUMNS = ["company", "source_type", "fetch_page", "url"]


def unkept(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The step as a plan."""
    return df


@dataclass(frozen=True)
class Context:
    """What normalisers need besides the pages.

    `configs` maps a source name (`*` for all others) to its adapter
    configuration, a small dict; `details` holds landed detail answers.
    `keep(df, name, by)` may write a step, partitioned by a column, and go on from
    the table.
    """

    sources: DataFrame
    run_ts: Column
    details: DataFrame | None = None
    pack: RulePack = POSTING
    configs: dict[str, dict] = field(default_factory=dict)
    keep: Callable[..., DataFrame] = unkept


def detail_cap(ctx: Context) -> Cap | None:
    """Each source's configured `detail_fetch_cap`; None, or NULL in the column, is no cap."""
    caps = {c: int(cfg["detail_fetch_cap"]) for c, cfg in ctx.configs.items() if cfg.get("detail_fetch_cap") is not None}
    if not caps:
        return None
    most = max(caps.values())
    fallback = F.lit(caps.pop("*", None)).cast("int")
    return Cap(lookup(F.col("company"), caps, fallback) if caps else fallback, most)


@dataclass(frozen=True)
class Normalized:
    records: DataFrame
    problems: DataFrame

    def accepted(self, keep: Callable[..., DataFrame] = unkept) -> DataFrame:
        """Rows of sources without a problem: one bad page fails its source.

        The failed names are narrow and few: once kept, their size is known when the join
        is planned, and no text moves.
        """
        failed = keep(self.problems.select("company").distinct(), "failed-sources")
        return self.records.join(failed, "company", "left_anti")


Normalizer = Callable[[DataFrame, Context], Normalized]
REGISTRY: dict[tuple[str, str], Normalizer] = {}


def register(source_type: str, preset: str = "") -> Callable[[Normalizer], Normalizer]:
    """Plug a normaliser in for a source type (and preset)."""

    def add(fn: Normalizer) -> Normalizer:
        REGISTRY[(source_type, preset)] = fn
        return fn

    return add


def kind_name(source_type: str, preset: str = "") -> str:
    return f"{source_type}:{preset}" if preset else source_type


def source_kind() -> Column:
    """What a source's pages are read as, as a name; unknown presets mean a mapping."""
    presets = [p for t, p in REGISTRY if t == "json" and p]
    named = F.substring_index(text_or_empty(F.col("source_identifier")), ":", 1)
    typed = text_or_empty(F.col("source_type"))
    return F.when((typed == "json") & named.isin(presets), F.concat(F.lit("json:"), named)).otherwise(
        F.when(typed == "", F.lit("none")).otherwise(typed)
    )


def source_pages(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages with their source's type, kind, identifier, and a sortable page position.

    How a page is read is up to the source dimension, not to the landed row; pages
    of a table that `land` wrote have their kind from that dimension already.
    """
    dim = sources.select(
        F.col("name").alias("company"), "source_no", "source_type", source_kind().alias("kind"),
        text_or_empty(F.col("source_identifier")).alias("source_identifier"),
        text_or_empty(F.col("careers_url")).alias("careers_url"),
    )
    if "kind" in payloads.columns:
        dim = dim.drop("kind")
    return payloads.drop("source_type", "preset").join(dim, "company").withColumn(
        "fetch_page", F.struct("source_no", "query_no", "page_no")
    )


def land(payloads: DataFrame, sources: DataFrame, path: str) -> DataFrame:
    """Write landed pages partitioned by kind, and read them back.

    A run over this table reads, per normaliser, that kind's partition and nothing else.
    """
    dim = sources.select(F.col("name").alias("company"), source_kind().alias("kind"))
    kinds = payloads.join(dim, "company", "left").withColumn("kind", F.coalesce("kind", F.lit("none")))
    kinds.write.mode("overwrite").partitionBy("kind").parquet(path)
    return payloads.sparkSession.read.schema(kinds.schema).parquet(path)


def page_order(place: Column | None = None) -> Column:
    """Fetch order of one item: source, query, page, place in the page.

    A place is a pair (block, position); pages with one list have one block.
    """
    place = F.struct(F.lit(0), "pos") if place is None else place
    return F.struct(
        F.col("fetch_page.source_no").alias("source_no"),
        F.col("fetch_page.query_no").alias("query_no"),
        F.col("fetch_page.page_no").alias("page_no"),
        place.cast("struct<block:int,pos:int>").alias("place"),
    )


def open_items(
    ctx: Context, pages: DataFrame, schema: str, items: Callable[[Column], Column], *,
    needs: Column | None = None, failed: Callable[[Column], Column] | None = None,
    root: str = "{",
) -> tuple[DataFrame, DataFrame]:
    """Explode a JSON page's record list; pages without it go to the problems.

    A page is bad JSON, misses its list, or its source misses an identifier.  One
    parse gives a page's items or its category; only a page that failed is looked
    at again, to tell bad JSON from a missing list.
    """
    usable = needs if needs is not None else F.lit(True)
    wanted = F.startswith(F.ltrim("body"), F.lit(root)) & usable

    def listed(payload: Column) -> Column:
        refused = F.coalesce(failed(payload), F.lit(False)) if failed is not None else F.lit(False)
        return F.when(~refused, items(payload))

    category = (
        F.when(~usable, F.lit("invalid_config"))
        .when(F.try_parse_json("body").isNull(), F.lit("parse_error"))
        .otherwise(F.lit("structure_changed"))
    )
    opened = let(F.when(wanted, let(F.from_json("body", schema), listed)), lambda found: opened_rows(found, category))
    return split_opened(ctx, pages, opened)


def opened_rows(found: Column, category: Column) -> Column:
    """A page's items, or one row with the category of a page without a list."""
    fine = F.lit(None).cast("string").alias("category")
    return F.when(
        found.isNull(), F.array(F.struct(F.get(found, F.lit(0)).alias("item"), category.alias("category")))
    ).otherwise(F.transform(found, lambda item: F.struct(item.alias("item"), fine)))


def split_opened(ctx: Context, pages: DataFrame, opened: Column) -> tuple[DataFrame, DataFrame]:
    """Items (with `fetch_ord`) and problems of pages with their `opened_rows`.

    The category comes out of the explode, so a filter on it cannot be pushed below, where it would parse again.
    """
    rest = [c for c in pages.columns if c != "body"]
    each = ctx.keep(
        explode_once(pages.select(*rest, opened.alias("items"))).select(*rest, "pos", "item.item", "item.category"), "opened"
    )
    good = each.where("category IS NULL").drop("category").withColumn("fetch_ord", page_order())
    return good, problem_rows(each.where("category IS NOT NULL"))


def explode_once(df: DataFrame) -> DataFrame:
    """Explode `items` into (pos, item).

    A plain explode makes the optimizer add a filter on the array and push it
    down, which would parse every page a second time; the outer form does not.
    """
    rest = [c for c in df.columns if c != "items"]
    return df.select(*rest, F.posexplode_outer("items").alias("pos", "item")).where("pos IS NOT NULL")


def problem_rows(checked: DataFrame) -> DataFrame:
    """Rows with a category; a column `note` says what in the configuration is to blame."""
    note = F.nullif("note", F.lit("")) if "note" in checked.columns else F.lit(None).cast("string")
    return checked.where("category IS NOT NULL").select(
        "company", "category",
        F.concat_ws(" ", F.col("company"), F.lit("page"), F.col("url"), F.lit(":"), F.col("category"), note).alias("message"),
    )


def normalize(payloads: DataFrame, ctx: Context) -> Normalized:
    """Dispatch every page to the normaliser of its source's kind.

    Pages are dealt out by kind once (`keep` partitions them); a branch reads its
    partition.  A table that `land` wrote is read as it is.  Only kinds that occur in the
    source dimension get a branch (that list is at most as long as the registry).  Sources
    without a normaliser are reported as `unsupported`; disabled sources are left out and
    appear as skipped in the health step.
    """
    live = ctx.sources.where(~skipped_source(F.col("enabled"), F.col("source_type")))
    names = {kind_name(t, p): (t, p) for t, p in REGISTRY}
    landed = source_pages(payloads, ctx.keep(live, "live-sources"))
    if "kind" not in payloads.columns:
        landed = ctx.keep(landed, "landed", "kind")
    # A fetch that failed lands as a row whose context names the error.
    error = F.get_json_object("context_json", "$.error_category")
    message = F.get_json_object("context_json", "$.error_message")
    pages = landed.where(error.isNull())
    is_known = F.col("kind").isin(list(names))
    present = live.select(source_kind().alias("kind")).where(is_known).distinct()
    kinds = sorted(r["kind"] for r in present.take(len(names)))

    problems = [
        problem_rows(pages.where(~is_known).withColumn("category", F.lit("unsupported"))),
        landed.where(error.isNotNull()).select(
            "company", error.alias("category"), text_or_empty(message).alias("message")
        ),
    ]
    records = []
    for kind in kinds:
        def keep(df: DataFrame, name: str, by: str | None = None, kind: str = kind) -> DataFrame:
            return ctx.keep(df, f"{name}-{kind.replace(':', '-')}", by)

        done = REGISTRY[names[kind]](pages.where(F.col("kind") == kind), replace(ctx, keep=keep))
        records.append(done.records)
        problems.append(done.problems)
    if not records:
        none = pages.where(F.lit(False)).withColumn("pos", F.lit(0))
        records.append(none.select("company", "source_type", page_order().alias("fetch_ord")))
    return Normalized(
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), records),
        reduce(DataFrame.unionByName, problems),
    )
