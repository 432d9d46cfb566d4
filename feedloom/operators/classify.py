"""Row-wise text classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contained, let, passage, truncate
from ..rules import RulePack

# A year, and what ties it to graduation.
YEAR_PATTERN = r"(?U)(?<!\w)20[0-9]{2}(?!\w)"
YEAR_CONTEXT_PATTERN = (
    r"(?iU)(?:graduat\w+|class of|degree|expected|completion)[^0-9]{0,40}(?<!\w)20[0-9]{2}(?!\w)"
    r"|(?<!\w)20[0-9]{2}(?!\w)[^0-9]{0,40}(?:graduat\w+|grads?(?!\w))"
)


def sponsorship_hits(text: Column, pack: RulePack) -> Column:
    """struct of the four hit lists; the text is lower-cased once for all of them."""
    return let(
        F.lower(text),
        lambda low: F.struct(
            contained(low, pack.ineligible).alias("ineligible"),
            contained(low, pack.negative).alias("negative"),
            contained(low, pack.positive).alias("positive"),
            contained(low, pack.weak_positive).alias("weak_positive"),
        ),
    )


def _any(hits: Column) -> Column:
    return F.size(hits) > 0


def sponsorship_class(hits: Column) -> Column:
    """The most restrictive signal wins, wherever it stands in the text."""
    return (
        F.when(_any(hits["ineligible"]), F.lit("ineligible"))
        .when(_any(hits["negative"]), F.lit("likely_not_supported"))
        .when(_any(hits["positive"]), F.lit("likely_supported"))
        .when(_any(hits["weak_positive"]), F.lit("possibly_supported"))
        .otherwise(F.lit("unclear"))
    )


def deciding_phrase(hits: Column) -> Column:
    """First hit of the list that decided the class, NULL when none hit."""
    return F.coalesce(
        *[F.get(hits[k], F.lit(0)) for k in ("ineligible", "negative", "positive", "weak_positive")]
    )


def evidence(text: Column, phrase: Column) -> Column:
    """The passage that shows the phrase, or the phrase itself; empty without one.

    Every hit phrase occurs in the text, so the first one always has a passage.
    """
    def shown(c: Column) -> Column:
        found = F.nullif(passage(c["text"], c["phrase"]), F.lit(""))
        return truncate(F.coalesce(found, c["phrase"]), 400)

    both = F.struct(text.alias("text"), phrase.alias("phrase"))
    return F.when(phrase.isNull(), F.lit("")).otherwise(let(both, shown))


def with_sponsorship(df: DataFrame, pack: RulePack, text: Column | None = None) -> DataFrame:
    """Adds classification, evidence and risk flags."""
    text = F.concat_ws(" ", "title", "description", "requirements") if text is None else text
    hits = F.col("_hits")
    return (
        df.withColumn("_hits", sponsorship_hits(text, pack))
        .withColumns(
            {
                "sponsorship_classification": sponsorship_class(hits),
                "sponsorship_evidence": evidence(text, deciding_phrase(hits)),
                "international_student_risk_flags": F.concat(hits["ineligible"], hits["negative"]),
            }
        )
        .drop("_hits")
    )


def mentioned_years(title: Column, description: Column) -> Column:
    """Years in the title, else years near graduation words in the description."""
    in_title = F.regexp_extract_all(title, F.lit(YEAR_PATTERN), F.lit(0))
    in_text = F.when(
        F.rlike(description, F.lit("20[0-9]{2}")),
        F.regexp_extract_all(description, F.lit(YEAR_CONTEXT_PATTERN), F.lit(0)),
    ).otherwise(F.array().cast("array<string>"))
    # A context match holds one year, at its start or at its end.
    years = lambda found: F.transform(
        found, lambda m: F.regexp_extract(m, "^20[0-9]{2}|20[0-9]{2}$", 0).cast("int")
    )
    return let(in_title, lambda t: F.when(F.size(t) > 0, years(t)).otherwise(years(in_text)))


def graduation(title: Column, description: Column, pack: RulePack) -> Column:
    """struct(match, note) by the years a posting mentions."""

    def pick(years: Column) -> Column:
        ints = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
        return F.struct(
            F.array_max(F.array_intersect(years, ints(pack.compatible_years))).alias("good"),
            F.array_max(F.array_intersect(years, ints(pack.incompatible_years))).alias("bad"),
            F.array_max(years).alias("last"),
        )

    def judge(y: Column) -> Column:
        def verdict(kind: str, year: Column, *note: str | Column) -> Column:
            text = F.concat(*[F.lit(n) if isinstance(n, str) else n for n in note])
            return F.struct(
                F.concat(F.lit(f"{kind}_"), year.cast("string")).alias("match"), text.alias("note")
            )

        good, bad, last = (y[k].cast("string") for k in ("good", "bad", "last"))
        early = F.when(y["good"] == 2027, F.lit("matches May 2027 graduation")).otherwise(
            F.lit("matches potential Dec 2026 early graduation")
        )
        return (
            F.when(
                y["good"].isNotNull(),
                verdict("compatible", y["good"], "posting targets ", good, " grads — ", early),
            )
            .when(
                y["bad"].isNotNull(),
                verdict(
                    "incompatible", y["bad"], "posting targets ", bad,
                    " grads, before the candidate's earliest availability (Dec 2026)",
                ),
            )
            .when(
                y["last"] > max(pack.compatible_years),
                verdict(
                    "future", y["last"], "posting targets ", last,
                    " grads (later than needed but possibly open)",
                ),
            )
            .otherwise(
                F.struct(
                    F.lit("unspecified").alias("match"),
                    F.lit("no graduation year stated; assumed open to upcoming grads").alias("note"),
                )
            )
        )

    return let(let(mentioned_years(title, description), pick), judge)


def with_graduation(df: DataFrame, pack: RulePack) -> DataFrame:
    """Adds `graduation_match` and `graduation_note`."""
    return (
        df.withColumn("_grad", graduation(F.col("title"), F.col("description"), pack))
        .withColumns({"graduation_match": F.col("_grad.match"), "graduation_note": F.col("_grad.note")})
        .drop("_grad")
    )


def _ascii_bounds(pattern: str) -> str:
    r"""`\b` over ASCII letters at both sides of a word, spelled out for Java."""
    out, opening = [], True
    for piece in pattern.split(r"\b"):
        out.append(piece)
        out.append("(?<![A-Za-z0-9_])" if opening else "(?![A-Za-z0-9_])")
        opening = not opening
    return "".join(out[:-1])


def family(title: Column, pack: RulePack) -> Column:
    """First matching family of the pack, else `other`."""
    chain = F
    for name, pattern in pack.families:
        chain = chain.when(title.rlike("(?iu)" + _ascii_bounds(pattern)), F.lit(name))
    return chain.otherwise(F.lit("other"))


def has_new_grad_marker(matched: Column, pack: RulePack) -> Column:
    """Any marker is part of any matched term."""
    return F.exists(
        matched,
        lambda term: F.exists(
            F.array(*[F.lit(m) for m in pack.new_grad_markers]), lambda m: F.contains(term, m)
        ),
    )
