"""Text functions built only from Spark expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s and \w know ASCII only.  (?U)\s is Unicode; the separators
# U+001C..U+001F count as white space too.
SPACE = r"[\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside `body`.

    Catalyst may inline a projected column into every place that uses it; a
    lambda argument cannot be inlined, so a lower-cased text is built once per
    row however many terms are tested against it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literals(terms: Sequence[str]) -> Column:
    if not terms:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(str(t)) for t in terms])


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def first_filled(*values: Column) -> Column:
    """First value that is neither NULL nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def strip_ws(value: Column) -> Column:
    return F.regexp_replace(value, f"(?U)^{SPACE}+|{SPACE}+$", "")


# White space that is not yet one plain space: most spaces need no replacement.
_UNEVEN = rf"(?U)[\s\x1c-\x1f&&[^ ]]{SPACE}*| {SPACE}+"


def normalize_ws(value: Column) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(value), _UNEVEN, " "))


def truncate(value: Column, limit: int) -> Column:
    def cut(v: Column) -> Column:
        short = F.regexp_replace(F.left(v, F.lit(limit - 1)), f"(?U){SPACE}+$", "")
        return F.when(F.length(v) > limit, F.concat(short, F.lit("…"))).otherwise(v)

    return let(value, cut)


def md_escape(value: Column) -> Column:
    """Make a text safe inside one cell of a pipe table."""
    out = F.replace(text_or_empty(value), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("|"), F.lit("\\|"))
    return strip_ws(F.replace(out, F.lit("\n"), F.lit(" ")))


def slug(value: Column) -> Column:
    dashed = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def contained(lowered: Column, terms: Sequence[str]) -> Column:
    """Terms that occur anywhere in an already lower-cased text, in given order.

    A higher-order filter over a constant array keeps the generated code small
    for packs of any length (one branch per term would not be JIT-compiled).
    """
    terms = [str(t) for t in terms]
    if all(t == t.lower() for t in terms):
        return F.filter(literals(terms), lambda t: F.contains(lowered, t))
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(t.lower()).alias("low")) for t in terms])
    return F.transform(F.filter(pairs, lambda p: F.contains(lowered, p["low"])), lambda p: p["t"])


def phrase_hits(text: Column, phrases: Sequence[str]) -> Column:
    """Phrases that occur in the text as substrings, case-insensitively."""
    return let(F.lower(text), lambda low: contained(low, phrases))


def on_boundary(lowered: Column, term: Column) -> Column:
    """The term stands between non-word characters (so "c#" works too)."""
    pattern = F.concat(F.lit(rf"(?<!{WORD})\Q"), F.lower(term), F.lit(rf"\E(?!{WORD})"))
    return F.rlike(lowered, pattern)


def word_hits_in(lowered: Column, terms: Sequence[str]) -> Column:
    """As `word_hits`, for a text that is lower-cased already.

    Terms are trimmed for the test.  The cheap substring test runs first; only its survivors meet a regex.
    """
    return F.filter(
        literals(terms), lambda t: F.contains(lowered, F.lower(F.trim(t))) & on_boundary(lowered, F.trim(t))
    )


def word_hits(text: Column, terms: Sequence[str]) -> Column:
    return let(F.lower(text), lambda low: word_hits_in(low, terms))


def any_word_hit(text: Column, terms: Column) -> Column:
    """True when any term of an array column occurs on word boundaries."""
    return F.coalesce(
        let(
            F.lower(text),
            lambda low: F.exists(
                terms, lambda t: F.contains(low, F.lower(F.trim(t))) & on_boundary(low, F.trim(t))
            ),
        ),
        F.lit(False),
    )


def passage(text: Column, phrase: Column, context: int = 160) -> Column:
    """The sentence around the first hit of `phrase`; a long one is clipped.

    The text is cut at the hit.  What follows the last sentence mark on the
    left, and what leads up to and includes the first mark on the right, is the
    sentence; each side is clipped to `context` characters when both together
    exceed twice that.
    """

    def around(c: Column) -> Column:
        left = F.substring(c["text"], F.lit(1), c["at"] - 1)
        for mark in (".", "\n", "•"):
            left = F.substring_index(left, mark, -1)
        right = F.substring(c["text"], c["at"] + c["len"], F.length(c["text"]))
        stop = F.length(F.substring_index(F.substring_index(right, ".", 1), "\n", 1)) + 1
        return F.struct(
            left.alias("left"),
            F.substring(c["text"], c["at"], c["len"]).alias("hit"),
            F.left(right, stop).alias("right"),
        )

    def join(p: Column) -> Column:
        clip = F.length(p["left"]) + F.length(p["right"]) > 2 * context
        return F.concat(
            F.when(clip, F.right(p["left"], F.lit(context))).otherwise(p["left"]),
            p["hit"],
            F.when(clip, F.left(p["right"], F.lit(context))).otherwise(p["right"]),
        )

    cut = F.struct(
        text.alias("text"),
        F.position(F.lower(phrase), F.lower(text)).alias("at"),
        F.length(phrase).alias("len"),
    )
    found = let(cut, lambda c: F.when(c["at"] > 0, let(around(c), join)))
    return text_or_empty(normalize_ws(found))
