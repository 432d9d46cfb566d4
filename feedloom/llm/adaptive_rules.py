"""Quality rules with thresholds that adapt to each language and source.

Counts per document are plain column expressions.  Each ratio is kept in steps of a thousandth, and a sketch
of its distribution is the number of documents per step: sketches of two sets of rows merge by adding counts, so they
are exact sums with map-side combine, the same on every run, and a quantile is right to one step.  Per language
and source, the fence of a ratio is its median plus the larger of `SPREAD` times the distance from median
to upper quartile and the ratio's least width.  A group of fewer than `LEAST` documents uses the merged sketch of its
language, and a language of fewer the merged sketch of all.  Documents above any fence, and those that fail the
base rules, are rejected.

Only column functions and SQL aggregates are used; the fences (a few rows per language and source) are joined back.

Nulls: a NULL text has no words and fails the base rules; NULL languages and sources are groups of their own.  Repeated
rows count as often as they occur.  An empty table gives an empty result.  Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, text_or_empty
from ..session import written
from .common import carry, if_small, text_hash

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Ratios in thousandths, and how far above the median a fence is at least.
WIDTHS = {"symbols": 30, "shouting": 200, "exclamations": 60, "dup_lines": 500, "repeats": 300}
SPREAD, LEAST = 6, 100
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(tokens: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text.

    Windows are hashed; only a text whose hashes are not all different sorts them with their positions.
    """

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        )

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        place = F.transform(
            s, lambda e, j: F.when((e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]), e["i"])
        )
        return let(F.sort_array(F.filter(place, lambda x: x.isNotNull())), covered)

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(pairs), repeated))

    return let(hashes(tokens), count)


def counts(text: Column) -> Column:
    """All counts of a text as one struct, each intermediate value built once."""

    def of_text(t: Column) -> Column:
        tokens = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, WHITE, "") != "")

        def of_words(w: Column) -> Column:
            solid = F.translate(t, WHITE, "")
            return let(lines, lambda rows: let(solid, lambda s: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(s).cast("long").alias("word_chars"),
                (F.length(s) - F.length(F.translate(s, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).cast("long").alias("n_repeat_words"),
                F.size(rows).cast("long").alias("n_lines"),
                F.regexp_count(s, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
                (F.length(s) - F.length(F.translate(s, "!", ""))).cast("long").alias("n_exclamations"),
            )))

        return let(tokens, of_words)

    return let(text_or_empty(text), of_text)


def _ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.least(F.lit(1000), F.floor(F.try_divide(F.lit(1000) * F.col(part), F.col(whole)))), F.lit(0)).cast("int")


def measured(docs: DataFrame) -> DataFrame:
    """The input's columns, `_c` (struct of counts) and one column `_r_<name>` per ratio."""
    rows = docs.withColumn("_c", counts(F.col("text")))
    return rows.withColumns({
        "_r_symbols": _ratio("_c.n_symbols", "_c.word_chars"),
        "_r_shouting": _ratio("_c.n_upper", "_c.word_chars"),
        "_r_exclamations": _ratio("_c.n_exclamations", "_c.n_words"),
        "_r_dup_lines": _ratio("_c.n_dup_lines", "_c.n_lines"),
        "_r_repeats": _ratio("_c.n_repeat_words", "_c.n_words"),
    })


def base_failed() -> Column:
    return (F.col("_c.n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("_c.n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("_c.n_words")
    )


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, ratio, step, n): the mergeable sketch of every ratio per language and source."""
    steps = F.array(*[
        F.struct(F.lit(name).alias("ratio"), F.col(f"_r_{name}").alias("step")) for name in WIDTHS
    ])
    return (
        rows.select("lang", "source", F.explode(steps).alias("_s"))
        .groupBy("lang", "source", F.col("_s.ratio").alias("ratio"), F.col("_s.step").alias("step"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quantiles(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Per key and ratio: number of documents, and the fence, from merged sketches."""
    merged = sketch.groupBy(*keys, "ratio", "step").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")
    ranked = merged.withColumn("_all", F.sum("n").over(group)).withColumn(
        "_upto", F.sum("n").over(group.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    at = lambda q: F.min(F.when(F.lit(100) * F.col("_upto") >= F.lit(q) * F.col("_all"), F.col("step")))
    width = F.create_map(*[F.lit(x) for pair in WIDTHS.items() for x in pair])
    found = ranked.groupBy(*keys, "ratio").agg(
        F.first("_all").alias(f"{tag}_n"), at(50).alias("_q50"), at(75).alias("_q75")
    )
    fence = F.col("_q50") + F.greatest(F.lit(SPREAD) * (F.col("_q75") - F.col("_q50")), F.element_at(width, F.col("ratio")))
    return found.select(*keys, "ratio", f"{tag}_n", fence.alias(f"{tag}_fence"))


def fences(sketch: DataFrame) -> DataFrame:
    """(_lang, _source, _f_<ratio>...): one row per language and source."""
    own = _quantiles(sketch, ["lang", "source"], "own")
    lang = _quantiles(sketch, ["lang"], "lang").withColumnRenamed("lang", "_l").withColumnRenamed("ratio", "_lr")
    every = _quantiles(sketch, [], "every").select(F.col("ratio").alias("_er"), "every_fence")
    joined = own.join(lang, own["lang"].eqNullSafe(F.col("_l")) & (own["ratio"] == F.col("_lr"))).join(
        every, own["ratio"] == F.col("_er")
    )
    fence = F.when(F.col("own_n") >= LEAST, F.col("own_fence")).when(
        F.col("lang_n") >= LEAST, F.col("lang_fence")
    ).otherwise(F.col("every_fence"))
    return joined.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*[
        F.max(F.when(F.col("ratio") == name, fence)).alias(f"_f_{name}") for name in WIDTHS
    ])


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Measured rows with `_base_failed` and `_kept`."""
    joined = rows.join(limits, rows["lang"].eqNullSafe(F.col("_lang")) & rows["source"].eqNullSafe(F.col("_source")))
    above = F.lit(False)
    for name in WIDTHS:
        above = above | (F.col(f"_r_{name}") > F.col(f"_f_{name}"))
    return joined.withColumn("_base_failed", base_failed()).withColumn("_kept", ~F.col("_base_failed") & ~above)


def verdicts(metrics: DataFrame) -> DataFrame:
    """doc_id, counts, ratios, base_failed and kept from narrow measured rows (see `metrics_of`)."""
    rows = judged(metrics, fences(sketches(metrics)))
    return rows.select(
        "doc_id", *[F.col(f"_c.{c}").alias(c) for c in COUNTS],
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"),
        *[F.col(f"_r_{name}").alias(f"{name}_permille") for name in WIDTHS],
    )


def metrics_of(docs: DataFrame) -> DataFrame:
    """Narrow measured rows: a hash (`_th`) in place of the text."""
    rows = measured(docs.select("doc_id", "lang", "source", "text")).withColumn("_th", text_hash(F.col("text")))
    return rows.select("doc_id", "lang", "source", "_th", "_c", *[f"_r_{name}" for name in WIDTHS])


def kept_documents(docs: DataFrame, metrics: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only, from their (written) `metrics_of`.

    Texts are measured once: the narrow rows are judged, and the documents meet the keys of the rejected ones.
    """
    bad = judged(metrics, fences(sketches(metrics))).where(~F.col("_kept"))
    keys = ("doc_id", "lang", "source", "_th")
    rejected = written(bad.select(*[F.col(c).alias(f"_bad_{c}") for c in keys]).distinct(), "rejected")
    rows = carry(docs, "doc_id", "lang", "source", "text").withColumn("_th", text_hash(F.col("text")))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_bad_{c}"))
    return rows.join(if_small(rejected), same, "left_anti").select("_row.*")


def rules_sql(documents: str = "documents") -> str:
    """DuckDB SQL for `verdicts`; exact windows instead of hashes."""
    white = r"[\x20\x09-\x0D]"
    widths = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WIDTHS.items())
    ratios = ", ".join(f"('{k}', {k}_permille)" for k in WIDTHS)

    def quantiles(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""{name} AS (
  SELECT {by}ratio, max(total) AS n, med + greatest({SPREAD} * (upq - med), CASE ratio {widths} END) AS fence FROM (
    SELECT {by}ratio, max(total) AS total, min(CASE WHEN 100 * upto >= 50 * total THEN step END) AS med,
      min(CASE WHEN 100 * upto >= 75 * total THEN step END) AS upq
    FROM (SELECT *, sum(n) OVER (PARTITION BY {by}ratio ORDER BY step) AS upto, sum(n) OVER (PARTITION BY {by}ratio) AS total
      FROM (SELECT {by}ratio, step, count(*) AS n FROM long GROUP BY ALL))
    GROUP BY {by}ratio) GROUP BY {by}ratio, med, upq)"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM {documents}),
w AS (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
g AS (SELECT rid, unnest(generate_series(1, len(w) - 2)) AS i, w FROM w WHERE len(w) >= 3),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
  regexp_replace(t, '{white}', '', 'g') AS s FROM d),
m AS (SELECT d.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(s) AS BIGINT) AS word_chars,
  CAST(length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  len(lines) AS n_lines, length(s) - length(regexp_replace(s, '\\p{{Lu}}', '', 'g')) AS n_upper,
  length(s) - length(replace(s, '!', '')) AS n_exclamations
  FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN c USING (rid)),
x AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  CAST(CASE WHEN word_chars = 0 THEN 0 ELSE least(1000, 1000 * n_symbols // word_chars) END AS INT) AS symbols_permille,
  CAST(CASE WHEN word_chars = 0 THEN 0 ELSE least(1000, 1000 * n_upper // word_chars) END AS INT) AS shouting_permille,
  CAST(CASE WHEN n_words = 0 THEN 0 ELSE least(1000, 1000 * n_exclamations // n_words) END AS INT) AS exclamations_permille,
  CAST(CASE WHEN n_lines = 0 THEN 0 ELSE least(1000, 1000 * n_dup_lines // n_lines) END AS INT) AS dup_lines_permille,
  CAST(CASE WHEN n_words = 0 THEN 0 ELSE least(1000, 1000 * n_repeat_words // n_words) END AS INT) AS repeats_permille FROM m),
long AS (SELECT rid, lang, source, ratio, step FROM x, LATERAL (VALUES {ratios}) v(ratio, step)),
{quantiles("own", "lang, source")}, {quantiles("bylang", "lang")}, {quantiles("everything", "")},
f AS (SELECT own.lang, own.source, own.ratio, CASE WHEN own.n >= {LEAST} THEN own.fence WHEN bylang.n >= {LEAST} THEN bylang.fence
  ELSE everything.fence END AS fence FROM own JOIN bylang ON own.lang IS NOT DISTINCT FROM bylang.lang AND own.ratio = bylang.ratio
  JOIN everything ON own.ratio = everything.ratio),
bad AS (SELECT DISTINCT rid FROM long JOIN f ON long.lang IS NOT DISTINCT FROM f.lang AND long.source IS NOT DISTINCT FROM f.source
  AND long.ratio = f.ratio WHERE step > fence)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND bad.rid IS NULL AS kept, {", ".join(f"{k}_permille" for k in WIDTHS)}
FROM x LEFT JOIN bad USING (rid)
"""
