"""Hard negatives, spelling variants and page texts against brute force, with odd rows, ties, repeats and empty tables."""

from __future__ import annotations

import collections
import html
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import dom, hard_negatives, html_extraction, spelling


# ---------------------------------------------------------- 11: hard negatives
def brute_negatives(rows, anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    def ok(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    kept = [(i, lab, [int(np.floor(scale * float(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and ok(v)]
    dot = lambda a, b: max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for a in sorted({r[0] for r in kept if anchor(r[0])}):
        _, lab, v = min((r for r in kept if r[0] == a), key=lambda r: (r[2], r[1]))
        scored = sorted((-dot(v, r[2]), r[0], r[1]) for r in kept if r[0] != a)
        best = [(-s, i) for s, i, label in scored if label == lab][:positives]
        for ps, p in best:
            fit = [(-s, i) for s, i, label in scored if label != lab and low * ps <= -100 * s <= high * ps][:negatives]
            out += [(a, p, n + 1, i, ps, s) for n, (s, i) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("own") for c in ("id", "v", "n", "rank")})
    return sorted(map(tuple, hard_negatives.mined(frame, F.col("label"), F.col("vec_id") % 10 == 0, **more).collect()))


@pytest.mark.parametrize("block, group, sample", [(8192, 512, 4096), (7, 2, 3), (16, 3, 0)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, group, sample):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    monkeypatch.setattr(hard_negatives, "SAMPLE", sample)
    rng = np.random.default_rng(3)
    # A third of all rows has one label, some are equal, some are far shorter; coordinates are skewed.
    rows = []
    for i in range(90):
        v = (rng.normal(size=20) * np.linspace(0.02, 1, 20) + 0.3).astype(np.float32).tolist()
        rows.append((i, v, 0 if i % 3 == 0 else int(rng.integers(1, 4))))
    rows += [(200 + i, rows[4][1], 1) for i in range(6)] + [(210, rows[4][1], 2), (4, rows[5][1], 1)]
    rows += [(300, [0.1, 0.2], 1), (310, [], 2), (320, None, 1), (330, [float("nan")], 1), (340, [None, 1.0], 0), (350, [1.0], None),
             (None, [1.0], 1), (0, [-1.0] * 20, 0), (360, [float("inf")], 2)]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_wide_numbers_and_of_nothing(spark):
    rows = [(0, [3e15, 1.0], 1), (1, [2.9e15, -1.0], 1), (2, [2.5e15, 5.0], 2), (3, [2.5e15, 5.0], 2), (4, [1e30, 0.0], 1), (5, [-1e30, 1.0], 2)]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []


def test_covered_dimensions_are_in_no_list():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(200, 32)) * np.linspace(0.01, 1, 32) * 100
    norms = hard_negatives.prefix_norms(y[:20])
    # A threshold that half of the rows cannot reach with any of the anchors.
    least = float(norms[:, -1].max() * np.median(np.linalg.norm(y, axis=1)))
    index = hard_negatives.Index(y, np.arange(32), norms.max(axis=0), least)
    assert (index.first > 0).any() and len(index.listed) < len(y)
    for floor in (least, least / 2):
        index = hard_negatives.Index(y, np.arange(32), norms.max(axis=0), floor)
        for i in range(20):
            found = set(index.candidates(y[i], norms[i], floor, np.ones(len(index.listed), bool)).tolist())
            assert set(np.flatnonzero(y @ y[i] >= floor).tolist()) <= found


# ------------------------------------------------------------ 12: spelling
def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(docs, least=6, at_least=5, times=5, one_in=199):
    counts = collections.Counter()
    for ident, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= least
    words = {w: n for w, n in counts.items() if n >= at_least}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 4])
def test_variants_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "HELD", 50)
    monkeypatch.setattr(spelling, "LONG_TEXT", 2_000)
    rng = random.Random(5)
    # Words of two letters over few positions: nearly all are near one another, and halves are hot.
    words = ["".join(rng.choice("abÉé") for _ in range(rng.choice([6, 6, 7, 8]))) for _ in range(120)]
    words += ["z" * 3_000, "z" * 3_001, "z" * 2_999 + "y", "Straße", "strasse", "straße×", "naïveté", "÷÷÷÷÷÷"]
    docs = [(i, " ".join(rng.choices(words, [1 + 3 * (k % 17 == 0) * 10 for k in range(len(words))], k=400))) for i in range(20)]
    docs += [(1, docs[1][1]), (None, "abcdef1abcdef ABCDEF_abcdef\nabcdef"), (50, None), (51, ""), (52, " ".join(words) * 6)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("word", "n", "half", "l", "part", "a", "b", "own")})
    got = sorted(map(tuple, spelling.variants(frame, one_in=13).collect()))
    assert got == brute_variants(docs, one_in=13)
    assert any(r[1] and r[2] != r[1] for r in got) or any(r[1] for r in got)


def test_pairs_of_a_block_are_exactly_those_one_apart():
    rng = random.Random(2)
    for _ in range(20):
        words = sorted({"".join(rng.choice("xyü") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 140))}, key=len, reverse=True)
        i, j = spelling.near_pairs(words)
        got = list(zip(i.tolist(), j.tolist()))
        want = {(a, b) for a, b in itertools.permutations(range(len(words)), 2) if one_apart(words[a], words[b])}
        assert len(got) == len(set(got)) and set(got) == want


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(11)]
    found = spelling.roots(spark.createDataFrame(chain, "word string, form string"))
    assert {r["root"] for r in found.collect()} == {"w11"} and found.count() == 11
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "doc_id long, text string"), times=1)


def test_no_documents_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------ 13: page texts
@pytest.fixture(scope="module")
def model():
    return html_extraction.default_model()


def text_of(page, model):
    return html_extraction.main_texts([dom.read_page(page)], model)[0]


def test_messages_equal_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 6, 9):
        parent = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)])
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
        kinds = rng.integers(0, len(dom.EDGES), n)
        tree = html_extraction.Forest(np.zeros((n, 1)), kinds, parent, levels, np.array([0]))
        node, pair = rng.normal(size=n), rng.normal(size=(len(dom.EDGES), 2, 2))
        log_node, log_joint, total = html_extraction.messages(tree, node, pair)
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            weight[y] = np.exp(sum(node[i] * y[i] for i in range(n)) + sum(pair[kinds[i], y[parent[i]], y[i]] for i in range(1, n)))
        z = sum(weight.values())
        assert np.isclose(total, np.log(z))
        for i in range(n):
            assert np.isclose(np.exp(log_node[i, 1]), sum(w for y, w in weight.items() if y[i]) / z)
            if i:
                both = sum(w for y, w in weight.items() if y[i] and y[parent[i]]) / z
                assert np.isclose(np.exp(log_joint[i, 1, 1]), both)


def test_held_out_pages(model):
    pages = html_extraction.labelled_pages(200, seed=11)
    t = html_extraction.forest(pages)
    said = model.marginals(t) >= 0.5
    hit = extra = missed = 0
    for page, start in zip(pages, t.starts):
        for i, text in enumerate(page.texts):
            if text is not None:
                n = len(text.split())
                hit += n * (said[start + i] and page.mark[i])
                extra += n * (said[start + i] and not page.mark[i])
                missed += n * (not said[start + i] and page.mark[i])
    assert hit / (hit + extra) > 0.99 and hit / (hit + missed) > 0.99


def test_pages_of_the_table(spark, sf_dir, model):
    """The table's pages hold their text in one <article>; its blocks are the heading and the paragraphs."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in html_extraction.extracted(pages, model).collect()}
    for row in pages.collect():
        article = re.search("(?s)<article>(.*)</article>", row["html"])[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</h1>|</p>|<p>", article))
        want = "\n\n".join(b for b in blocks if b)
        assert (got[row["page_id"]]["text"], got[row["page_id"]]["n_chars"], got[row["page_id"]]["url"]) == (want, len(want), row["url"])


BLOG = """<html><head><title>T</title></head><body class="home single-post"><div id="page"><header class="site-header">
<h1><a href="/">My Blog</a></h1><p>Just another blog about cooking</p></header><nav><ul><li><a href="/">Home</a><li><a href="/a">About us</a></ul></nav>
<main><article class="post-12"><header class="entry-header"><h1>How to boil an egg</h1></header><div class="entry-content">
<p>Take an egg &amp; put it in   water.</p><p>Wait.</p><ul><li>Soft: four minutes</li><li>Hard: ten minutes</li></ul></div></article>
<div id="comments"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><article><footer>Bob says:</footer>
<p>I tried that, and it worked rather well, thank you very much for the recipe. It is good.</p></article></li></ol></div></main>
<aside class="widget-area"><h2>Recent Posts</h2><ul><li><a href=1>Pasta at home</a></li></ul></aside><footer>&copy; 2024</footer></div></body></html>"""
PAPER = """<html><body><table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td><h2>Storm hits the coast</h2>
<p>A heavy storm has hit the northern coast on Sunday, and thousands of homes lost power.<p>No one was hurt.</td></tr></table>
<center>Copyright 1999 The Paper. All rights reserved. <a href=x>Contact</a></center>"""
DIVS = """<div class="cookieBanner">We use cookies to improve your visit. <a href=x>Accept</a></div><div class="storyBody"><h1>Council votes</h1>
<div>The council voted on Tuesday to build a new bridge over the river.</div><div class="adSlot">Advertisement</div>
<div class="newsletterSignup"><p>Get our best stories every morning in your inbox.</p><form><input></form></div><div>Work begins in May.</div></div>
<div class="disqus-thread"><p>Ann: what a waste of money, they should fix the roads first, I think.</p></div>"""


@pytest.mark.parametrize("page, want", [
    (BLOG, "How to boil an egg\n\nTake an egg & put it in water.\n\nWait.\n\nSoft: four minutes\n\nHard: ten minutes"),
    (PAPER, "Storm hits the coast\n\nA heavy storm has hit the northern coast on Sunday, and thousands of homes lost power.\n\nNo one was hurt."),
    (DIVS, "Council votes\n\nThe council voted on Tuesday to build a new bridge over the river.\n\nWork begins in May."),
    ("Plain text. No markup &lt;at all&gt;, a < b.", "Plain text. No markup <at all>, a < b."),
    ('<script>var x="<p>no</p>"</script><p title="a>b">Yes, this&nbsp;one.<br>And this.</p><!-- no --><style>p{}</style>', "Yes, this one. And this."),
    ("<p>An unclosed <b>bold text that goes on, <p>and on. <!-- never closed <p>no</p>", "An unclosed bold text that goes on,\n\nand on."),
    ("<nav><a href=1>x</a></nav>", ""), ("", ""), ("<p>Quote's here, it's fine.</p><script>never closed", "Quote's here, it's fine."),
])
def test_pages_of_other_kinds(model, page, want):
    assert text_of(page, model) == want


def test_odd_pages(spark, model):
    long = "<article><h1>Long</h1>" + "<p>Some words, and some more of them.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>Same here, as it is.</p>"), (None, "v", "<p>Same here, as it is.</p>"), (3, "w", long), (4, "x", "<" * 5_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("text", "n_chars")})
    got = html_extraction.extracted(frame, model).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in got)[:2] == [(0, "v", 20), (0, "v", 20)]
    by_id = {r["page_id"]: r for r in got}
    assert by_id[1]["text"] == by_id[2]["text"] == "" and by_id[2]["url"] is None
    assert by_id[3]["text"].count("\n\n") == 20_000 and by_id[3]["n_chars"] == len(by_id[3]["text"])
    assert html_extraction.extracted(frame.limit(0), model).count() == 0
