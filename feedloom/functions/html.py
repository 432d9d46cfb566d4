"""HTML to text.

Plain markup is handled by Spark expressions, inside the JVM.  Only rows that
need a real parser (unusual entities, broken tags) are sent to a Python worker;
for all other rows the worker receives NULL.
"""

from __future__ import annotations

import html as html_std
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .slices import by_slices
from .text import let, normalize_ws, text_or_empty

# Elements whose text is not part of the page's text.
HIDDEN = frozenset({"script", "style", "template", "rt", "rp"})

# Markup whose removal needs no parser: comments, hidden elements, whole tags.
# All alternatives share their first character, so other text is skipped fast.
_BLOCKS = (
    r"(?is)<(?:!--.*?-->|(script|style)\b[^<>]*(?<!/)>.*?</\1\s*>|!doctype[^<>]*>"
    r"|/?[a-z][a-z0-9]*(?:\s[^<>\"']*(?:\"[^\"<>]*\"[^<>\"']*|'[^'<>]*'[^<>\"']*){0,40})?>)"
)
# Markers that the short way does not cover: elements that hide text but may
# nest, raw-text elements, other declarations, unusual entities.
_RARE_TAGS = (
    r"(?is)<(?:template|rt|rp|textarea|title\b[^>]*/|script\b[^>]*/|style\b[^>]*/"
    r"|noscript|iframe|xmp|noembed|noframes|plaintext|!\[|\?)"
)
_RARE_ENTITIES = r"&(?!(?:amp|lt|gt|quot|apos|nbsp|copy|middot|#39|#x27);|\s|&|$)"
# The entities decoded on the short way; `amp` must come last.
_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&#x27;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]


class _TextCollector(HTMLParser):
    """Collects the visible strings of a page; shared by the text and row readers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self._hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self._hidden.append(tag)
        self.pieces.append(" ")

    def handle_startendtag(self, tag, attrs):
        self.pieces.append(" ")

    def handle_endtag(self, tag):
        if tag in self._hidden:
            while self._hidden.pop() != tag:
                pass
        self.pieces.append(" ")

    def handle_comment(self, data):
        self.pieces.append(" ")

    def handle_decl(self, decl):
        self.pieces.append(" ")

    def handle_data(self, data):
        if not self._hidden:
            self.pieces.append(data)


def page_text(markup: str) -> str:
    collector = _TextCollector()
    collector.feed(markup)
    collector.close()
    return "".join(collector.pieces)


@arrow_udf(T.StringType())
def _parse_text(markup: pa.Array) -> pa.Array:
    return by_slices(lambda v: None if v is None else page_text(v), pa.string(), markup)


@arrow_udf(T.StringType())
def _unescape_all(value: pa.Array) -> pa.Array:
    return by_slices(lambda v: None if v is None else html_std.unescape(v), pa.string(), value)


def decode_common(value: Column) -> Column:
    def decode(v: Column) -> Column:
        out = v
        for entity, char in _ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(char))
        return F.when(F.contains(v, F.lit("&")), out).otherwise(v)

    return let(value, decode)


def unescape(value: Column) -> Column:
    """Decode entities; only texts with unusual ones go to a Python worker."""
    rare = value.rlike(r"&(?!(?:amp|lt|gt|quot|apos|nbsp|copy|middot|#39|#x27);)[A-Za-z#]")
    parsed = _unescape_all(F.when(rare, value))
    return F.when(rare, parsed).otherwise(decode_common(value))


def _short_way(value: Column) -> Column:
    """The text by expressions alone, and whether that was not enough."""

    def stripped(v: Column) -> Column:
        return let(
            F.regexp_replace(v, _BLOCKS, " "),
            lambda bare: F.struct(
                decode_common(bare).alias("text"),
                (
                    v.rlike(_RARE_TAGS) | v.rlike(_RARE_ENTITIES) | F.contains(bare, F.lit("<"))
                ).alias("hard"),
            ),
        )

    return let(
        value,
        lambda v: F.when(
            ~F.contains(v, F.lit("<")), F.struct(v.alias("text"), F.lit(False).alias("hard"))
        ).otherwise(stripped(v)),
    )


def strip_html(df: DataFrame, *names: str) -> DataFrame:
    """Replace the named columns by their visible text, white space normalised.

    A text without any tag is not decoded, only normalised.
    """
    quick = df.withColumns({f"_quick_{n}": _short_way(text_or_empty(F.col(n))) for n in names})
    done = {}
    for name in names:
        hard = F.col(f"_quick_{name}.hard")
        parsed = _parse_text(F.when(hard, F.col(name)))
        done[name] = normalize_ws(F.when(hard, parsed).otherwise(F.col(f"_quick_{name}.text")))
    return quick.withColumns(done).drop(*[f"_quick_{n}" for n in names])
