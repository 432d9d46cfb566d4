"""Main text of web pages by a tree-structured graphical model over the DOM.

A page is a tree of block elements with text blocks as leaves (`dom`).  Every node has a hidden label, content or not.  Its features give a
node potential, and each parent-child edge has a potential over both labels, by the kind of the child.  Sum-product message
passing, once from the leaves up and once from the root down, gives the exact marginal of every node; the text blocks whose
marginal is at least one half are the main text.  A short paragraph is so kept by the prose around it, and a long comment falls
with its list.

The weights are trained here, by gradient ascent on the likelihood of labelled pages; its expected counts come from the same
messages.  The labelled pages are a bounded set of `pages` (default `PAGES`) that `labelled_pages` lays out, always the same:
invented words in many layouts, with the parts of a site that are no article.  Callers may hand in their own labelled pages.

Scoring is one pass over the pages in tasks; pages of a batch are one forest, so messages move level by level in numpy.

Defined results: NULL or empty html gives the empty text, as does a page without content.  White space (line breaks of <br> included) inside
a block is one space; blocks are joined by two line feeds, and nothing is cut, however long.  Repeated rows give repeated results, an
empty table an empty one; NULL ids and urls are passed on; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import EDGES, Page, features, read_page

PAGES, ROUNDS, RIDGE = 400, 150, 1e-4
#: Pages of a batch are read together up to so many characters.
BATCH_PAGES, BATCH_CHARS = 64, 1 << 20
LABEL = "data-label"


# ------------------------------------------------------------------ the model
@dataclass
class Forest:
    """Trees of several pages in one set of arrays."""

    f: np.ndarray
    edges: np.ndarray
    parent: np.ndarray
    levels: list[np.ndarray]
    starts: np.ndarray


def forest(pages: list[Page]) -> Forest:
    parts = [features(p) for p in pages]
    sizes = np.array([len(p.parent) for p in pages])
    starts = np.cumsum(sizes) - sizes
    parent = np.concatenate([np.array(p.parent) + s for p, s in zip(pages, starts)])
    depth = np.concatenate([p.depth for p in pages])
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, depth.max() + 1))
    return Forest(
        np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]), parent,
        np.split(order, cuts), starts,
    )


def _sum_out(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(x.take(0, axis), x.take(1, axis))


def messages(t: Forest, node: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum-product: (log marginals per node, log marginals per edge as (node, parent's label, own label), log partition).

    `node` has the log potential of label 1 (label 0 has 0), `pair` those of an edge kind as (kind, parent's label, own label).
    """
    up = np.zeros((len(node), 2))
    up[:, 1] = node
    sent = np.zeros_like(up)
    for level in reversed(t.levels[1:]):
        both = up[level][:, None, :] + pair[t.edges[level]]
        sent[level] = _sum_out(both, 2)
        for y in (0, 1):
            np.add.at(up[:, y], t.parent[level], sent[level, y])
    whole = np.zeros_like(up)
    joint = np.zeros((len(node), 2, 2))
    roots = t.levels[0]
    total = _sum_out(up[roots], 1)
    whole[roots] = up[roots]
    for level in t.levels[1:]:
        # What the parent believes without this child, and each pair of labels with it.
        rest = whole[t.parent[level]] - sent[level]
        joint[level] = rest[:, :, None] + pair[t.edges[level]] + up[level][:, None, :]
        whole[level] = _sum_out(joint[level], 1)
    tree = np.zeros(len(node))
    tree[roots] = total
    for level in t.levels[1:]:
        tree[level] = tree[t.parent[level]]
    return whole - tree[:, None], joint - tree[:, None, None], float(total.sum())


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, t: Forest) -> np.ndarray:
        """Chance of every node to be content."""
        return np.exp(messages(t, t.f @ self.weights, self.pair)[0][:, 1])


def node_labels(page: Page) -> np.ndarray:
    """Marks of text blocks; an element is content if most words below it are."""
    n = len(page.parent)
    words, inside = np.zeros(n), np.zeros(n)
    for i in range(n - 1, -1, -1):
        if page.texts[i] is not None:
            words[i] = page.texts[i].count(" ") + 1
            inside[i] = words[i] * page.mark[i]
        if i:
            words[page.parent[i]] += words[i]
            inside[page.parent[i]] += inside[i]
    return np.where(words > 0, 2 * inside > words, np.array(page.mark) > 0).astype(int)


def train(pages: list[Page], rounds: int = ROUNDS, ridge: float = RIDGE) -> Model:
    """Weights of the greatest penalised likelihood, by Adam over all pages."""
    t = forest(pages)
    labels = np.concatenate([node_labels(p) for p in pages])
    child = np.concatenate(t.levels[1:]) if len(t.levels) > 1 else np.empty(0, int)
    seen_pair = np.zeros((len(EDGES), 2, 2))
    np.add.at(seen_pair, (t.edges[child], labels[t.parent[child]], labels[child]), 1)
    n_f, n = t.f.shape[1], len(pages)
    theta = np.zeros(n_f + seen_pair.size)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        pair = theta[n_f:].reshape(seen_pair.shape)
        log_node, log_joint, _ = messages(t, t.f @ theta[:n_f], pair)
        expected = np.zeros_like(seen_pair)
        np.add.at(expected, t.edges[child], np.exp(log_joint[child]))
        gradient = np.concatenate([t.f.T @ (labels - np.exp(log_node[:, 1])), (seen_pair - expected).ravel()]) / n - ridge * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient * gradient
        theta = theta + 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return Model(theta[:n_f], theta[n_f:].reshape(seen_pair.shape))


# ------------------------------------------------------------ labelled pages
class _Layout:
    """Lays out one labelled page.  Content carries the label 1, all else inherits 0."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.named = self.r.random() < 0.7
        self.semantic = self.r.random() < 0.5

    # Words and blocks -----------------------------------------------------
    def word(self) -> str:
        word = "".join(self.r.choice(["ba", "ti", "on", "er", "lé", "mu", "s", "th", "ing", "ña", "ß", "ro", "ka"]) for _ in range(self.r.randint(1, 4)))
        return word + self.r.choice(["###", "%%%", "&amp;&amp;", "$", "***"]) if self.junk and self.r.random() < 0.6 else word

    junk = False

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(2, 22).capitalize() + self.r.choice([".", ".", ".", "!", "?", ", " + self.word() + "."])

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(low, high)}</a>'

    def names(self, *options: str) -> str:
        if not self.named:
            return ""
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(options)}"'

    def wrap(self, tag: str, inside: str, *names: str, plain: str = "div") -> str:
        tag = tag if self.semantic else plain
        return f"<{tag}{self.names(*names) if names else ''}>{inside}</{tag}>"

    # Parts that are no content ---------------------------------------------
    def menu(self) -> str:
        links = [self.link() for _ in range(self.r.randint(3, 9))]
        inside = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if self.r.random() < 0.7 else self.r.choice([" | ", " "]).join(links)
        return self.wrap("nav", inside, "menu", "main-nav", "navbar", "navigation top")

    def header(self) -> str:
        title = self.r.choice(["<h1>{}</h1>", "<p>{}</p>", "<a href='/'>{}</a>", "<div>{}</div>"]).format(self.words(1, 3))
        return self.wrap("header", title + (self.menu() if self.r.random() < 0.5 else f"<p>{self.words(2, 6)}</p>"), "header", "masthead", "site-header", "banner")

    def footer(self) -> str:
        text = self.r.choice([f"&copy; {self.words(1, 3)} &middot; {self.sentence()}", f"Copyright 2024 {self.words(1, 2)}. All rights reserved.",
                              " ".join(self.link() for _ in range(4)), f"<p>{self.prose(1, 2)}</p><p>{self.link()} {self.link()}</p>"])
        return self.wrap("footer", text, "footer", "site-footer", "colophon", "page-bottom")

    def advert(self) -> str:
        text = self.r.choice([self.prose(1, 2), f"Advertisement {self.words(3, 12)}", f"<p>{self.sentence()}</p>{self.link()}", f"<p>Sponsored</p><p>{self.prose(1, 2)}</p>"])
        return f'<div {self.r.choice(["class", "id"])}="{self.r.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad"])}">{text}</div>'

    def notice(self) -> str:
        text = self.r.choice([f"This site uses cookies. {self.prose(1, 2)}", f"Subscribe to our newsletter. {self.sentence()}", self.prose(1, 2)])
        name = self.r.choice(["cookie-notice", "consent", "notice", "alert", "newsletter", "popup", "notification-bar"])
        return f'<{"section" if self.semantic else "div"} class="{name}"><p>{text}</p>{self.r.choice(["", "<button>OK</button>", self.link()])}</{"section" if self.semantic else "div"}>'

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)} <input name=x></label>" for _ in range(self.r.randint(1, 3)))
        return f"<form>{self.r.choice(['', f'<p>{self.sentence()}</p>', f'<h3>{self.words(1, 3)}</h3>'])}{fields}<button>{self.word()}</button></form>"

    def share(self) -> str:
        return self.wrap("div", " ".join(self.link(1, 1) for _ in range(4)), "share", "social-links", "sharing")

    def related(self) -> str:
        items = "".join(f"<li>{self.link(3, 9)}{self.r.choice(['', ' ' + self.words(3, 8)])}</li>" for _ in range(self.r.randint(3, 7)))
        return self.wrap("aside", f"<h3>{self.r.choice(['Related', 'Read more', 'See also', self.words(1, 3)])}</h3><ul>{items}</ul>", "related", "more-stories", "recommended")

    def sidebar(self) -> str:
        inside = "".join(self.r.choice([self.related, lambda: f"<h4>{self.words(1, 3)}</h4><p>{self.prose(1, 2)}</p>", self.form, self.menu])() for _ in range(self.r.randint(1, 3)))
        return f'<aside>{inside}</aside>' if self.semantic else f'<div class="{self.r.choice(["sidebar", "side", "widget-area", "right-rail"])}">{inside}</div>'

    def comments(self) -> str:
        one = self.r.choice(["li", "div", "article", "section"])
        name = self.r.choice(["comment", "comment-body", "reply"])
        each = "".join(
            f'<{one} class="{name}"><p>{self.r.choice([self.words(1, 2), self.words(1, 2) + " says:", self.link()])}</p><p>{self.prose(1, 5)}</p></{one}>'
            for _ in range(self.r.randint(1, 6))
        )
        inside = f"<ol>{each}</ol>" if one == "li" else each
        head = self.r.choice(["<h2>Comments</h2>", f"<h3>{self.r.randint(2, 40)} comments</h3>", ""])
        tag = self.r.choice(["section", "div"])
        return f'<{tag} {self.r.choice(["id", "class"])}="{self.r.choice(["comments", "comment-list", "discussion", "responses"])}">{head}{inside}{self.r.choice(["", self.form()])}</{tag}>'

    def unseen(self) -> str:
        how = self.r.choice(["hidden", 'style="display: none"', 'aria-hidden="true"'])
        return f"<div {how}><p>{self.prose(1, 3)}</p></div>"

    # The article ------------------------------------------------------------
    def block(self) -> str:
        kind = self.r.random()
        if kind < 0.58:
            return f"<p>{self.prose()}</p>"
        if kind < 0.68:
            return f"<p>{self.words(1, 3).capitalize()}.</p>"
        if kind < 0.74:
            return f"<p><b>{self.prose(1, 4)}<br>"
        if kind < 0.80:
            return f"<h{self.r.choice('23')}>{self.words(1, 6)}</h{self.r.choice('23')}>" if self.r.random() < 0.1 else f"<h2>{self.words(1, 6)}</h2>"
        if kind < 0.85:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.r.choice([self.words(1, 8), self.sentence()])}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}>"
        if kind < 0.89:
            return f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>"
        if kind < 0.92:
            return f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>"
        if kind < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 4))) + "</table>"
        if kind < 0.97:
            return f"<pre>{self.words(3, 20)}</pre>"
        return f"<p>{self.sentence()} {self.link()} {self.prose(1, 3)} {self.link(1, 4)}.</p>"

    def article(self) -> str:
        low, high = self.r.choice([(1, 2), (2, 6), (4, 15), (15, 40)])
        blocks = [self.block() for _ in range(self.r.randint(low, high))]
        # Parts inside the article that do not belong to it.
        for part, chance in ((self.advert, 0.15), (self.related, 0.15), (self.share, 0.15), (self.notice, 0.15), (self.form, 0.15),
                             (self.unseen, 0.08), (self.comments, 0.05)):
            if self.r.random() < chance:
                inner = part()
                blocks.insert(self.r.randint(0, len(blocks)), f'<div {LABEL}="0">{inner}</div>' if self.r.random() < 0.3 else self._unlabelled(inner))
        title = f"<h1>{self.words(1, 10)}</h1>" if self.r.random() < 0.85 else ""
        if title and self.r.random() < 0.15:
            title = f"<header>{title}</header>"
        if self.r.random() < 0.25:
            # Sections of a few blocks, with or without a heading of their own.
            tag, step = self.r.choice(["section", "div"]), self.r.randint(1, 4)
            groups = ["".join(blocks[i:i + step]) for i in range(0, len(blocks), step)]
            blocks = [f"<{tag}>{self.r.choice(['', f'<h2>{self.words(1, 5)}</h2>'])}{g}</{tag}>" for g in groups]
        inside = title + "".join(blocks)
        kind = self.r.random()
        if kind < 0.45:
            name = self.r.choice(["", "", ' class="post"', ' id="content"', ' class="hentry story"'])
            return f'<article{name} {LABEL}="1">{inside}</article>'
        if kind < 0.6:
            return f'<main {LABEL}="1">{inside}</main>'
        if kind < 0.85:
            name = self.r.choice(["content", "post-content", "article-body", "main", "entry", "story", "text"])
            body = f'<div class="{name}" {LABEL}="1">{inside}</div>'
            return f"<div>{body}</div>" if self.r.random() < 0.4 else body
        return f'<div {LABEL}="1">{inside}</div>'

    @staticmethod
    def _unlabelled(part: str) -> str:
        """A part with the label 0 on its first element."""
        cut = part.index(">")
        return f'{part[:cut]} {LABEL}="0"{part[cut:]}'

    def html(self) -> str:
        r = self.r
        self.junk = r.random() < 0.1
        bare = r.random()
        if bare < 0.04:
            return f'<div {LABEL}="1">{self.prose(1, 8)}</div>'
        if bare < 0.07:
            return self.header() + self.menu() + self.footer()
        before = [x() for x in (self.header, self.menu, self.notice, self.advert, self.sidebar, self.form) if r.random() < 0.4]
        after = [x() for x in (self.share, self.related, self.comments, self.sidebar, self.advert, self.notice, self.form, self.unseen) if r.random() < 0.35]
        main = self.article()
        if r.random() < 0.2:
            # Comments may stand in the element that holds the article.
            main = f'<{r.choice(["main", "div", "section"])}>{main}{self.comments()}</'
            main += main[1:main.index(">")] + ">"
        if r.random() < 0.1:
            main = f"<table><tr><td>{self.menu()}</td><td>{main}</td></tr></table>"
        foot = [self.footer()] if r.random() < 0.85 else []
        if r.random() < 0.3:
            main, after = f'<div{self.names("container", "wrapper", "page")}>{main}{"".join(after)}</div>', []
        r.shuffle(before)
        head = f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><script>var t='</p>';</script></head><body>"
        return head + "".join(before) + main + "".join(after) + "".join(foot) + r.choice(["</body></html>", ""])


def labelled_pages(n: int, seed: int = 0) -> list[Page]:
    """`n` labelled pages, the same ones for the same seed."""
    return [read_page(_Layout(seed * 1_000_003 + i).html(), LABEL) for i in range(n)]


@lru_cache(maxsize=4)
def default_model(pages: int = PAGES) -> Model:
    return train(labelled_pages(pages))


# ----------------------------------------------------------------- extraction
def main_texts(pages: list[Page], model: Model) -> list[str]:
    """The content blocks of each page, in page order."""
    if not pages:
        return []
    t = forest(pages)
    content = model.marginals(t) >= 0.5
    return [
        "\n\n".join(text for text, on in zip(p.texts, content[s:s + len(p.texts)]) if text is not None and on)
        for p, s in zip(pages, t.starts)
    ]


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = model or default_model()
    kept = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    fields = [pa.field("text", pa.string()), pa.field("n_chars", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                trees, chars = [], 0
                while at + len(trees) < batch.num_rows and len(trees) < BATCH_PAGES and chars < BATCH_CHARS:
                    html = batch.column(2)[at + len(trees)].as_py()
                    chars += len(html)
                    trees.append(read_page(html))
                texts = main_texts(trees, model)
                part = batch.slice(at, len(trees))
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                schema = pa.schema([batch.schema.field(0), batch.schema.field(1), *fields])
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                at += len(trees)

    types = dict(kept.dtypes)
    return kept.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
