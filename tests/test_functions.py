"""Scalar functions on literal values."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.functions import dates, html, labels, paths, text, urls
from feedloom.rules import POSTING


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTPS://Ex.TEST/Jobs/7/?utm_source=a&b=2&empty=&Ref=z#frag", "https://ex.test/Jobs/7?b=2"),
        ("https://ex.test/jobs/1?utm_source=x", "https://ex.test/jobs/1"),
        ("https://ex.test/jobs/1/", "https://ex.test/jobs/1"),
        ("http://ex.test", "http://ex.test"),
        ("//ex.test/a", "https://ex.test/a"),
        ("https://ex.test/a;v=1?x=a%20b+c&y=%C3%A9", "https://ex.test/a?x=a+b+c&y=%C3%A9"),
        ("https://ex.test/a;b/c?q=50%&t=~*", "https://ex.test/a;b/c?q=50%25&t=~%2A"),
        ("  https://ex.test/a\n", "https://ex.test/a"),
        ("https://ex.test/?b=2&a=1&b=3", "https://ex.test?b=2&a=1&b=3"),
        ("", ""),
    ],
)
def test_canonical_url(one, url, expected):
    assert one(urls.canonical_url(F.col("u")), u=url) == expected


@pytest.mark.parametrize(
    ("href", "expected"),
    [
        ("/careers/1", "https://ex.test/careers/1"),
        ("next", "https://ex.test/jobs/next"),
        ("//cdn.test/x", "https://cdn.test/x"),
        ("http://other.test/", "http://other.test/"),
        ("?p=2", "https://ex.test/jobs/list?p=2"),
        ("", "https://ex.test/jobs/list?p=1#top"),
    ],
)
def test_absolute_url(one, href, expected):
    assert one(urls.absolute_url(F.col("b"), F.col("h")), b="https://ex.test/jobs/list?p=1#top", h=href) == expected


def test_normalize_ws_is_unicode(one):
    assert one(text.normalize_ws(F.col("t")), t="  a  b\n\x1dc ") == "a b c"
    assert one(text.normalize_ws(F.col("t")), t=None) == ""


@pytest.mark.parametrize(
    ("value", "terms", "expected"),
    [
        ("We use C# now", ["c#", "c", "us"], ["c#", "c"]),
        ("école cole", ["cole"], ["cole"]),
        ("école", ["cole"], []),
        ("SRT encoder", ["sr"], []),
        ("Sr. Engineer, New Graduate", ["sr", "new grad", "new graduate", "graduate"], ["sr", "new graduate", "graduate"]),
        ("a_b", ["a"], []),
        ("$$$ (a.b)", ["a.b", "$$$"], ["a.b", "$$$"]),
    ],
)
def test_word_hits(one, value, terms, expected):
    assert one(text.word_hits(F.col("t"), terms), t=value) == expected


def test_phrase_hits_are_substrings_in_order(one):
    assert one(text.phrase_hits(F.col("t"), ["itar", "MIL", "none"]), t="a Military site") == ["itar", "MIL"]


def test_passage_takes_the_sentence(one):
    body = "First one. We offer visa sponsorship here.\nLast • point"
    assert one(text.passage(F.col("t"), F.lit("visa")), t=body) == "We offer visa sponsorship here."
    assert one(text.passage(F.col("t"), F.lit("point")), t=body) == "point"
    assert one(text.passage(F.col("t"), F.lit("absent")), t=body) == ""


def test_passage_clips_both_sides(one):
    body = "x" * 500 + "NEEDLE" + "y" * 500
    found = one(text.passage(F.col("t"), F.lit("needle")), t=body)
    assert found == "x" * 160 + "NEEDLE" + "y" * 160
    short_left = "a. " + "b" * 10 + "NEEDLE" + "y" * 500
    assert one(text.passage(F.col("t"), F.lit("needle")), t=short_left) == "b" * 10 + "NEEDLE" + "y" * 160


def test_truncate_and_escape(one):
    assert one(text.truncate(F.col("t"), 5), t="abc  defg") == "abc…"
    assert one(text.truncate(F.col("t"), 5), t="abcde") == "abcde"
    assert one(text.md_escape(F.col("t")), t=" a|b\\c\nd ") == "a\\|b\\\\c d"
    assert one(text.slug(F.col("t")), t="D. E. Shaw & Cö.") == "d--e--shaw---cö"


@pytest.mark.parametrize(
    ("markup", "expected"),
    [
        ("<p>a</p><p>b &amp; c</p>", "a b & c"),
        ("no tags &amp; kept", "no tags &amp; kept"),
        ("<div>x<script>var t='</p>';</script>y<!-- <b>z</b> --></div>", "x y"),
        ("<p>caf&eacute; &notanentity; 1 < 2</p>", "café ¬anentity; 1 < 2"),
        ("<p title='a > b'>quoted</p>", "quoted"),
        ("<style>p{}</style>t<br/>u<template>hidden<b>x</b></template>v", "t u v"),
        ("<b>unclosed <i>tags", "unclosed tags"),
        ("", ""),
        (None, ""),
    ],
)
def test_strip_html(spark, markup, expected):
    df = spark.createDataFrame([(markup,)], "m STRING")
    assert html.strip_html(df, "m").first()["m"] == expected


def test_short_way_equals_parser_on_pages(spark, sf_dir):
    """Whatever the expressions handle alone must equal the parser's answer."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("html", F.col("html").alias("text"))
    for row in html.strip_html(pages, "text").toLocalIterator():
        assert row["text"] == " ".join(html.page_text(row["html"]).split())


def test_unescape(one):
    assert one(html.unescape(F.col("t")), t="&lt;p&gt;A &amp;amp; B&lt;/p&gt;") == "<p>A &amp; B</p>"
    assert one(html.unescape(F.col("t")), t="&eacute;&#233;") == "éé"


@pytest.mark.parametrize(
    ("shown", "expected"),
    [
        ("July 10, 2026", "2026-07-10"), ("Jul 1, 2026", "2026-07-01"), (" 2026-07-10 ", "2026-07-10"),
        ("soon", ""), ("", ""), (None, ""),
    ],
)
def test_us_date(one, shown, expected):
    assert one(dates.us_date(F.col("t")), t=shown) == expected


@pytest.mark.parametrize(
    ("shown", "expected"),
    [
        ("Posted Today", "2026-07-12"), ("Posted Yesterday", "2026-07-11"), ("Posted 3 Days Ago", "2026-07-09"),
        ("Posted 30+ Days Ago", "2026-06-12"), ("Posted 30+", "2026-06-11"), ("later", ""), ("", ""),
    ],
)
def test_relative_date(one, shown, expected):
    now = F.lit("2026-07-12 12:00:00").cast("timestamp")
    assert one(dates.relative_date(F.col("t"), now), t=shown) == expected


def test_epoch_dates(one):
    assert one(dates.epoch_seconds_date(F.col("t")), t="1782086400") == "2026-06-22"
    assert one(dates.epoch_seconds_date(F.col("t")), t="-5") == ""
    assert one(dates.epoch_seconds_date(F.col("t")), t="x") == ""
    assert one(dates.epoch_millis_date(F.col("t")), t="1782000000000") == "2026-06-21"


def test_age_and_ordinal(one):
    now = F.lit("2026-07-12 12:00:00").cast("timestamp")
    assert one(dates.age_days(F.col("t"), now), t="2026-06-28T09:00") == 14
    assert one(dates.age_days(F.col("t"), now), t="2027-01-01") == 0
    assert one(dates.age_days(F.col("t"), now), t="bad") is None
    assert one(dates.date_ordinal(F.col("t")), t="bad") == 0


def test_local_stamps(one):
    utc, local = dates.local_stamps(F.lit(datetime(2026, 7, 12, 6, 30)).cast("timestamp"))
    assert one(utc) == "2026-07-12 06:30 UTC"
    assert one(local) == "2026-07-12 14:30 Asia/Taipei"


DOC = '{"a":{"b":[{"c":1},{"c":2}]},"items":[{"list":[5]}],"s":"x","t":[["p","q"],["r"]]}'


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("a.b.c", ["1", "2"]), ("a.b.1.c", ["2"]), ("items.0.list", ["5"]), ("missing.path", None),
        ("s", ["x"]), ("items.9.list", None),
    ],
)
def test_dig(one, path, expected):
    assert one(paths.dig_values(F.try_parse_json(F.col("j")), path), j=DOC) == expected


def test_as_text_and_template(one):
    assert one(paths.as_text(F.col("t")), t='["a","b"]') == "a; b"
    assert one(paths.as_text(F.col("t")), t="plain") == "plain"
    assert one(paths.as_text(F.col("t")), t=None) == ""
    assert one(paths.fill_template("u/{id}/x", id=F.col("t")), t="7") == "u/7/x"


def test_bands_and_labels(one):
    band = lambda n: labels.score_band(F.lit(n), POSTING.thresholds)
    assert [one(band(n)) for n in (80, 79, 65, 64, 50, 49)] == [
        "excellent", "strong", "strong", "possible", "possible", "low",
    ]
    assert one(labels.sponsorship_badge(F.lit("unclear"))) == "⚪ unclear"
    assert one(labels.sponsorship_label(F.lit("other"))) == "other"


def test_terms_are_trimmed_before_both_tests(one):
    from feedloom.functions.text import any_word_hit, word_hits

    assert one(word_hits(F.col("x"), ["us ", "eu"]), x="Remote (US)") == ["us "]
    assert one(any_word_hit(F.col("x"), F.array(F.lit(" us "))), x="Remote (US)") is True


def test_only_a_local_session_makes_its_own_shared_folder():
    from types import SimpleNamespace

    import pytest

    from feedloom.session import shared_folder

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("yarn", "hdfs:/shared/")) == "hdfs:/shared"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master))
