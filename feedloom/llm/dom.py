"""Pages as trees: block elements and the text blocks below them, with the features a content model reads."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np

# Elements that begin and end a block, elements without end, elements whose text nobody reads.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset(
    "head title script style noscript template svg math iframe object canvas audio video select option textarea button "
    "datalist".split()
)
# An element that starts here ends the open elements named, up to the enclosing ones named.
IMPLIED = {
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), ({"h1", "h2", "h3", "h4", "h5", "h6"}, {"td", "th", "li", "div", "section", "article"})),
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
# Words of class, id, role and itemprop, by what they say of an element.
NAMED = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager paging toc skip topbar tabs links sitemap",
    "head": "header head masthead banner logo branding brand sitename hero topper",
    "foot": "footer foot copyright colophon legal imprint bottom contentinfo",
    "side": "sidebar side aside widget widgets rail complementary secondary column",
    "advert": "ad ads advert adverts advertisement advertising adv sponsored sponsor promo promoted promotion adsense dfp commercial "
              "werbung anzeige publicidad publicite",
    "comment": "comment comments commentlist commenter disqus respond reply replies discussion responses reaction reactions "
               "review reviews guestbook kommentar kommentare commentaire commentaires comentario comentarios",
    "notice": "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
              "signup paywall disclaimer announcement message toast warning",
    "share": "share sharing social follow twitter facebook whatsapp likes tags tag buttons toolbar tools",
    "related": "related recommended recommendations popular trending recent latest teaser teasers next prev previous more also readmore",
    "form": "form login search searchbox signin register contact subscribe input",
    "text": "article content contents main post entry body story text maincontent articlebody articletext prose richtext hentry "
            "postbody blogpost maintext",
}
# Words of short blocks, by what they introduce.
CUES = {
    "cue_comment": r"comments?|repl(?:y|ies)|responses?|kommentare?|commentaires?|comentarios?|said|says|wrote",
    "cue_notice": r"cookies?|subscribe|newsletter|sign up|log in|consent|browser|javascript|privacy",
    "cue_advert": r"advert\w*|sponsored|anzeige|werbung|publicidad|publicité",
    "cue_more": r"related|read more|see also|more from|popular|trending|recommended|share|follow us|next|previous|home|menu|search",
    "cue_legal": r"©|copyright|all rights|imprint|terms of",
}
_CUES = re.compile(r"(?<!\w)(?:" + "|".join(f"(?P<{name}>{words})" for name, words in CUES.items()) + r")(?!\w)", re.I)
_WORDS = {name: frozenset(words.split()) for name, words in NAMED.items()}
_PIECES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SAYING = ("class", "id", "role", "itemprop")
TAGS = (
    "article main section div p h1 h2 h3 li ul ol table tr td blockquote pre figure figcaption dl nav header footer aside form body text".split()
)


@dataclass
class Page:
    """Nodes in page order, parents first; `texts` has a text for text blocks, None for elements."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    named: list[frozenset] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    mark: list[int] = field(default_factory=list)


def saying(attributes: dict[str, str | None]) -> frozenset:
    """What an element's names say of it."""
    said = " ".join(attributes[a] or "" for a in _SAYING if a in attributes)
    if not said:
        return frozenset()
    found = set(_PIECES.findall(_CAMEL.sub(" ", said).lower()))
    return frozenset(name for name, words in _WORDS.items() if found & words)


# An attribute is a name, or a name with a quoted or plain value; a comment that does not end takes the rest of the page.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?|=)*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|</(?![a-zA-Z])[^>]*>|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
# Elements whose inside is no markup.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in "script style title textarea noscript iframe xmp noembed noframes".split()}


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by name, the first of a name; character references are decoded."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        value = m[2] or m[3] or m[4] or ""
        found.setdefault(m[1].lower(), entities.unescape(value) if "&" in value else value)
    return found


class _Reader:
    """Builds a `Page`.  `label` names the attribute that marks labelled pages (1: content); other pages have none."""

    def __init__(self, label: str | None = None):
        self.label = label
        self.page = Page()
        # (tag, node); unread elements have node -1 and hide what is inside.
        self.open: list[tuple[str, int]] = []
        self.unread = 0
        self.pieces: list[str] = []
        self.in_link = False
        self.link_chars = 0
        self._element("body", {})

    def read(self, html: str) -> None:
        at = 0
        while m := _TOKEN.search(html, at):
            if m.start() > at:
                self.data(html[at:m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self.end(tag)
                elif tag in RAW:
                    # What it holds is neither text nor markup; without an end it takes the rest.
                    closing = RAW[tag].search(html, at)
                    at = closing.start() if closing else len(html)
                else:
                    self.start(tag, m[3])
        self.data(html[at:])
        self._flush()

    def _element(self, tag: str, attributes: dict) -> None:
        p, above = self.page, self._node()
        style = (attributes.get("style") or "").replace(" ", "").lower()
        p.parent.append(above)
        p.depth.append(p.depth[above] + 1 if above >= 0 else 0)
        p.tag.append(tag)
        p.named.append(saying(attributes))
        p.hidden.append("hidden" in attributes or "display:none" in style or attributes.get("aria-hidden") == "true")
        p.texts.append(None)
        p.linked.append(0)
        mark = attributes.get(self.label) if self.label else None
        p.mark.append(int(mark) if mark else (p.mark[above] if above >= 0 else 0))
        self.open.append((tag, len(p.parent) - 1))

    def _node(self) -> int:
        return next((node for _, node in reversed(self.open) if node >= 0), -1)

    def _flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            p, above = self.page, self._node()
            p.parent.append(above)
            p.depth.append(p.depth[above] + 1)
            p.tag.append("text")
            p.named.append(frozenset())
            p.hidden.append(False)
            p.texts.append(text)
            p.linked.append(self.link_chars)
            p.mark.append(p.mark[above])
        self.pieces, self.link_chars = [], 0

    def _leave(self, place: int) -> None:
        """Close the open elements from a place on."""
        if self.open[place:]:
            if any(node >= 0 for _, node in self.open[place:]):
                self._flush()
                self.in_link = False
            self.unread -= sum(node < 0 for _, node in self.open[place:])
            del self.open[place:]

    def _nearest(self, tags, until=frozenset()) -> int:
        for place in range(len(self.open) - 1, 0, -1):
            if self.open[place][0] in tags:
                return place
            if self.open[place][0] in until:
                break
        return 0

    def start(self, tag: str, said: str) -> None:
        if tag in BLOCKS:
            if tag == "html":
                # It may come late, or twice; what it says goes to the one root.
                self.page.named[0] |= saying(attributes_of(said))
                return
            if place := self._nearest({"head"}):
                self._leave(place)
            if place := self._nearest({"p"}, {"td", "th", "table", "caption"}):
                self._leave(place)
            if tag in IMPLIED and (place := self._nearest(*IMPLIED[tag])):
                self._leave(place)
            self._flush()
            if tag == "body":
                self.page.named[0] |= saying(attributes_of(said))
            elif tag not in VOID and not self.unread:
                self._element(tag, attributes_of(said) if said else {})
        elif tag in UNREAD:
            self.open.append((tag, -1))
            self.unread += 1
        elif tag == "br":
            self.pieces.append(" ")
        elif tag == "a":
            self.in_link = True

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        elif (tag in BLOCKS or tag in UNREAD) and tag not in ("html", "body"):
            if place := self._nearest({tag}):
                self._leave(place)

    def data(self, text: str) -> None:
        if not self.unread and text:
            text = entities.unescape(text) if "&" in text else text
            self.pieces.append(text)
            if self.in_link:
                self.link_chars += len(text)


def read_page(html: str | None, label: str | None = None) -> Page:
    reader = _Reader(label)
    reader.read(html or "")
    return reader.page


# ------------------------------------------------------------------- features
_SIZES = (2, 5, 10, 20, 50, 150, 500)
_PLACES = (0.02, 0.1, 0.3, 0.7, 0.9, 0.98)
_LINKS = (0.0, 0.3, 0.7)
FEATURES = (
    ["one", "hidden", "outside_article", "inside_article", "nested_article", "after_heading", "ends_sentence", "comma", "digits", "capitals"]
    + [f"tag_{t}" for t in TAGS] + [f"says_{n}" for n in NAMED] + [f"under_{n}" for n in NAMED] + list(CUES)
    + [f"words_{i}" for i in range(len(_SIZES) + 1)] + [f"block_words_{i}" for i in range(len(_SIZES) + 1)]
    + [f"place_{i}" for i in range(len(_PLACES) + 1)] + [f"links_{i}" for i in range(len(_LINKS) + 1)]
    + [f"blocks_{i}" for i in range(4)] + ["share_of_page", "alike"]
)
_AT = {name: i for i, name in enumerate(FEATURES)}
_TAG_AT = {t: _AT[f"tag_{t}"] for t in TAGS}
#: Kinds of parent-child potentials, by the child.
EDGES = ("text", "leaf", "part", "article", "aside", "other")
_EDGE = {
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt".split(), 1),
    **dict.fromkeys("ul ol li dl table tbody thead tfoot tr td th figure".split(), 2),
    "article": 3, "main": 3, **dict.fromkeys("nav header footer aside form".split(), 4), "text": 0,
}


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """One row of features and the kind of its edge to the parent, per node."""
    n = len(page.parent)
    words, chars, links, blocks = (np.zeros(n) for _ in range(4))
    before = np.zeros(n)
    seen, heading = 0, n
    sizes = [0] * n
    for i, text in enumerate(page.texts):
        before[i] = seen
        if text is not None:
            sizes[i] = text.count(" ") + 1
            words[i], chars[i], links[i], blocks[i] = sizes[i], len(text), page.linked[i], 1
            seen += sizes[i]
        elif page.tag[i] == "h1" and heading == n:
            heading = i
    alike: dict = {}
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        words[p] += words[i]
        chars[p] += chars[i]
        links[p] += links[i]
        blocks[p] += blocks[i]
        key = (p, page.tag[i], page.named[i])
        alike[key] = alike.get(key, 0) + 1
    within = [0] * n
    under: list[frozenset] = [frozenset()] * n
    any_article = any(t in ("article", "main") for t in page.tag)
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] |= holds[i] or page.tag[i] in ("article", "main")
    f = np.zeros((n, len(FEATURES)))
    f[:, 0] = 1
    edges = np.zeros(n, np.int64)
    total = max(1, seen)
    link_at, place_at = _AT["links_0"], _AT["place_0"]
    own_at, sub_at, block_at = _AT["words_0"], _AT["block_words_0"], _AT["blocks_0"]
    share = links / np.maximum(1, chars)
    link_no = np.searchsorted(_LINKS, share)
    place_no = np.searchsorted(_PLACES, (before + words / 2) / total)
    size_no = np.searchsorted(_SIZES, words)
    block_no = np.searchsorted((1, 3, 10), blocks)
    at = np.arange(n)
    f[at, link_at + link_no] = 1
    f[at, place_at + place_no] = 1
    f[at, block_at + block_no] = 1
    f[:, _AT["share_of_page"]] = words / total
    for i in range(n):
        tag, text = page.tag[i], page.texts[i]
        row = f[i]
        if i:
            p = page.parent[i]
            under[i] = under[p] | page.named[p]
            within[i] = within[p] + (page.tag[p] == "article")
        row[_TAG_AT.get(tag, 0)] = 1
        row[1] = page.hidden[i]
        if any_article:
            row[3 if within[i] or tag in ("article", "main") else 2] = not holds[i]
        row[4] = within[i] > 0 and tag == "article"
        row[5] = i > heading
        for name in page.named[i]:
            row[_AT[f"says_{name}"]] = 1
        for name in under[i]:
            row[_AT[f"under_{name}"]] = 1
        row[(own_at if text is not None else sub_at) + size_no[i]] = 1
        row[_AT["alike"]] = i > 0 and alike[(page.parent[i], tag, page.named[i])] > 2
        if text is not None:
            row[6] = text[-1] in ".!?…:;\"'”»)"
            row[7] = "," in text
            if sizes[i] <= 30:
                row[8] = sum(map(str.isdigit, text)) > 0.2 * len(text)
                row[9] = text.isupper()
                for cue in _CUES.finditer(text):
                    row[_AT[cue.lastgroup]] = 1
        edges[i] = _EDGE.get(tag, 5)
    return f, edges
