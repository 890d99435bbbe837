"""Main text of HTML pages by a tree-structured graphical model.

A page's block elements form a tree; text straight in the root or the body, and inline or unknown elements whose name, class, id or role says
what is no article (an advert in a ``span``), are nodes too.  Each node is content or not: a log-linear potential scores its own features (tag, words
in class and id, length, share of link text, place) and a 2 x 2 potential ties it to its parent.  Sum-product
messages go up from the leaves and down from the root, and a node's text is kept if its marginal is above 1/2.

The potentials are trained on a bounded sample of labelled pages (``max_pages``, picked by a hash): pages whose markup says
where the article is.  Each is also learned from without what says so (its article, main, header and such tags and its class names
taken away), so that the potentials hold for pages that name nothing.  Extraction is a map over all pages without a shuffle.

Defined cases: a null or empty page has the text ``""``; a text outside any block is a node of its own, and kept as a paragraph would be; drawings and players are dropped; unclosed and wrongly nested
tags are closed as browsers do for block elements; a tag that never ends is dropped with the rest of the page, as browsers do; a page of any
length and depth is read in time in proportion to it; repeated rows get equal texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnlens.llm.common import sliced

MAX_PAGES = 400
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
UNTIL_VALUE, VALUE, GAP = re.compile(r"[^>=]*+"), re.compile(r"[^\s>]*+"), re.compile(r"\s*+")
SPACE = re.compile(r"\s+")

# Fixed values of the HTML standard.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"))
#: Elements whose inside is no text of the page.
DROPPED = frozenset(("audio", "canvas", "math", "object", "svg", "video"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
BLOCK = frozenset(("address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
                   "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "html", "legend", "li",
                   "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
#: what a start tag closes, if it is the open block
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}

# Groups of words in class, id and role, and of tags, that features look at.
KEYWORDS = (
    ("nav", "menu", "breadcrumb", "pagination", "pager", "toc", "tabs", "toolbar"),
    ("ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner"),
    ("comment", "comments", "reply", "replies", "disqus", "respond", "discussion", "reader", "feedback"),
    ("sidebar", "aside", "widget", "related", "recommended", "popular", "share", "social", "follow", "newsletter", "subscribe", "signup"),
    ("footer", "header", "masthead", "copyright", "legal", "contentinfo", "complementary", "navigation", "search", "login"),
    ("cookie", "consent", "notice", "alert", "popup", "modal", "overlay", "gdpr"),
    ("content", "article", "post", "entry", "story", "main", "body", "text"),
)
TAGS = (("article", "main"), ("nav", "menu", "dir"), ("header",), ("footer",), ("aside",), ("form", "button", "select", "option", "fieldset", "legend", "dialog"),
        ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "li", "dl", "dt", "dd"), ("div", "section"),
        ("table", "tbody", "thead", "tr", "td", "th"), ("head",), ("html", "body"))
_TAG_OF = {t: k for k, ts in enumerate(TAGS) for t in ts}
_WORD_OF = {w: k for k, ws in enumerate(KEYWORDS) for w in ws}
N_FEATURES = 1 + len(TAGS) + len(KEYWORDS) + 7 + 3
#: Signs between the links of a menu that is written in one line.
BETWEEN = re.compile(r" [|·»›•/] ")
#: What says of a block that it and all in it is not the article: tags, and groups of words.
BAD, BAD_WORDS = frozenset(("nav", "aside", "footer", "form", "button", "select", "dialog", "menu")), frozenset((0, 1, 2, 3, 5))


@cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>?", re.I)


def _groups(text: str) -> frozenset[int]:
    return frozenset(_WORD_OF[w] for w in re.split(r"[^a-z]+", text.lower()) if w in _WORD_OF)


def _named(attributes: str) -> frozenset[int]:
    """Groups of the words in class, id and role."""
    return frozenset(k for m in NAMED.finditer(attributes) for k in _groups("".join(g or "" for g in m.groups())))


def tag_end(source: str, at: int) -> int:
    """The place behind the ``>`` that ends a tag whose name ends at ``at``; quotes count in values only; -1: it never ends."""
    while True:
        at = UNTIL_VALUE.match(source, at).end()
        if at >= len(source):
            return -1
        if source[at] == ">":
            return at + 1
        at = GAP.match(source, at + 1).end()
        if source[at : at + 1] in ("'", '"'):
            at = source.find(source[at], at + 1) + 1
            if not at:
                return -1
        else:
            at = VALUE.match(source, at).end()


class Page:
    """Nodes (parent, tag, keyword groups) and text segments (node, text, inside a link) of a page."""

    def __init__(self, source: str, named: bool = True) -> None:
        """``named``: whether to look at class, id and role and at the tags that tell parts of a page apart."""
        self.parent, self.tag, self.words, self.segments = [-1], ["html"], [frozenset()], []
        self._stack, self._links, self._open_tags, self._known, self._seen = [0], 0, Counter(), named, set()
        self._loose: int | None = None  # the node of the text straight in the root or the body
        self._inline: list[list] = []  # open inline nodes: name, and how many elements of it are open in it
        at, begin = 0, 0  # the text since ``begin`` is still to be taken
        while (at := source.find("<", at)) >= 0:
            close = source.startswith("/", at + 1)
            name = NAME.match(source, at + 1 + close)
            if name:
                end = tag_end(source, name.end())
            elif source.startswith("!--", at + 1):
                end = source.find("-->", at + 2) + 3 if source.find("-->", at + 2) >= 0 else -1
            elif source[at + 1 : at + 2] in ("!", "?") or close:
                end = source.find(">", at) + 1 or -1
            else:
                at += 1
                continue
            if at > begin:
                self._text(source[begin:at])
            tag, attributes = (name[0].lower(), source[name.end() : end]) if name else ("", "")
            at = begin = len(source) if end < 0 else end
            if end < 0 or not name:
                continue
            if tag in RAW and not close:
                found = _end_of(tag).search(source, at)
                at = begin = found.end() if found else len(source)
                self._break()
            elif tag in DROPPED and not close:
                found = None if attributes.endswith("/>") else _end_of(tag).search(source, at)
                at = begin = found.end() if found else at
            elif tag in BLOCK:
                self._close(tag) if close else self._open(tag, attributes)
            elif tag in ("br", "hr"):
                self._break()
            elif tag == "a":
                self._links = 0 if close else 1
            elif tag not in VOID:
                self._span(tag, attributes, close)
        if begin < len(source):
            self._text(source[begin:])

    def _span(self, name: str, rest: str, close: bool) -> None:
        """An inline or unknown element: a node if it says that it is no part of the article."""
        if self._inline and self._inline[-1][0] == name:
            self._inline[-1][1] += -1 if close else 1
            if not self._inline[-1][1]:
                links = self._links
                self._pop()
                self._links = links
        elif not close and self._known and (found := _named(rest) | _groups(name)) & BAD_WORDS:
            self._add(name, found)
            self._inline.append([name, 1])

    def _text(self, text: str) -> None:
        node = self._stack[-1]
        if self.tag[node] in ("html", "body"):
            if self._loose is None and not text.isspace():
                self._add("p", frozenset())
                self._loose = self._stack.pop()
                self._open_tags["p"] -= 1
            node = node if self._loose is None else self._loose
        if self.segments and self.segments[-1][0] == node:
            self.segments[-1][1].append(text)
            self.segments[-1][2].append(self._links)
        else:
            self.segments.append((node, [text], [self._links]))

    def _break(self) -> None:
        self._loose = None
        self.segments.append((-1, [], []))

    def _add(self, name: str, words: frozenset[int]) -> None:
        self._open_tags[name] += 1
        self.parent.append(self._stack[-1])
        self.tag.append(name)
        self.words.append(words)
        self._stack.append(len(self.tag) - 1)

    def _open(self, name: str, rest: str) -> None:
        self._links, self._loose = 0, None
        if name in ("html", "body"):
            if name in self._seen:
                return
            self._seen.add(name)
        top = self.tag[self._stack[-1]]
        if name not in ("option", "button") and top == "p" or top in CLOSES.get(name, ()) or _TAG_OF.get(top) == 7 and name != "option":
            self._pop()
            if name == "tr" and self.tag[self._stack[-1]] == "tr":
                self._pop()
        self._add(name, _named(rest) if self._known else frozenset())

    def _pop(self) -> str:
        name = self.tag[self._stack.pop()]
        if name not in BLOCK and self._inline:
            self._inline.pop()
        self._open_tags[name] -= 1
        return name

    def _close(self, name: str) -> None:
        self._links = 0
        if self._open_tags[name]:
            while self._pop() != name:
                pass
        self._break()

    def blocks(self) -> list[tuple[int, str, float]]:
        """(node, text, share of link text) of each block with text, in page order."""
        out = []
        for node, parts, links in self.segments:
            if node >= 0:
                text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
                if text:
                    total = sum(map(len, parts))
                    out.append((node, text, sum(len(p) for p, k in zip(parts, links, strict=True) if k) / total))
        return out

    def features(self, blocks: list[tuple[int, str, float]]) -> np.ndarray:
        n = len(self.tag)
        x = np.zeros((n, N_FEATURES))
        x[:, 0] = 1
        own, linked, ends, menus = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for node, text, link in blocks:
            own[node] += len(text)
            linked[node] += link * len(text)
            ends[node] += text[-1] in ".!?…"
            parts = BETWEEN.split(text)
            menus[node] += len(parts) > 2 and max(map(len, parts)) <= 24 and text[-1] not in ".!?…"
        around = np.zeros(n)  # the texts of the block's siblings and its own
        for i in range(1, n):
            around[self.parent[i]] += own[i]
        inside, marked = np.zeros(n, bool), np.zeros(n, bool)
        for i in range(1, n if self._known else 0):
            main, p = self.tag[i] in ("article", "main"), self.parent[i]
            inside[i] = main or inside[p]
            marked[i] = self.tag[i] != "body" and self.bad(i) or marked[p] and not main
        for i in range(n):
            if (k := _TAG_OF.get(self.tag[i])) is not None:
                x[i, 1 + (k if self._known or k > 5 else 9)] = 1
            for k in self.words[i]:
                x[i, 1 + len(TAGS) + k] = 1
        at = 1 + len(TAGS) + len(KEYWORDS)
        x[:, at] = np.log1p(own) / 5
        x[:, at + 1] = linked / np.maximum(own, 1)
        x[:, at + 2] = own > 0
        x[:, at + 3] = ends > 0
        x[1:, at + 4] = np.log1p(around[self.parent[1:]]) / 5
        x[:, at + 5] = own > 80
        x[:, at + 6] = menus > 0
        x[:, at + 7], x[:, at + 8], x[:, at + 9] = inside, marked, inside.any() & ~inside
        return x

    def bad(self, i: int) -> bool:
        """Whether the block itself says that it is not part of the article."""
        return self.tag[i] in BAD or bool(self.words[i] & BAD_WORDS)


def marginals(parent: list[int], unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """P(content) of each node; parents come before their children.  ``unary``: log odds; ``pair``: log potentials
    [parent, child]."""
    n = len(parent)
    up = np.zeros((n, 2))
    up[:, 1] = unary
    message = np.zeros((n, 2))
    for i in range(n - 1, 0, -1):
        message[i] = np.logaddexp(pair[:, 0] + up[i, 0], pair[:, 1] + up[i, 1])
        up[parent[i]] += message[i]
    down = up.copy()
    for i in range(1, n):
        rest = down[parent[i]] - message[i]
        down[i] = up[i] + np.logaddexp(rest[0] + pair[0], rest[1] + pair[1])
        down[i] -= down[i].max()
    return 1 / (1 + np.exp(np.clip(down[:, 0] - down[:, 1], -50, 50)))


def labelled(page: Page) -> np.ndarray | None:
    """1 for nodes in the article, 0 elsewhere, by the markup; None where it does not say."""
    y = np.zeros(len(page.tag))
    for i in range(len(page.tag)):
        p = page.parent[i]
        inside = page.tag[i] in ("article", "main") or p >= 0 and y[p] == 1
        y[i] = inside and not page.bad(i)
    return y if y.any() else None


def train(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Potentials by gradient ascent on the trees' pseudo-likelihood."""
    # what no sample need hold: boilerplate is boilerplate by these names, text in paragraphs is content
    prior = np.zeros(N_FEATURES)
    for k, w in ((1, 2.0), (2, -4), (3, -2), (4, -4), (5, -4), (6, -4), (7, 1), (8, 0.5), (12, -4)):
        prior[k] = w
    prior[1 + len(TAGS) : 1 + len(TAGS) + 7] = (-4, -4, -4, -4, -3, -4, 1)
    prior[1 + len(TAGS) + len(KEYWORDS) + 1] = -2
    prior[-4:] = (-8, 3, -10, -4)
    xs, ys, ps = [], [], []
    for source in pages:
        page = Page(source)
        if (y := labelled(page)) is not None:
            for seen in (page, Page(source, named=False)):
                xs.append(seen.features(seen.blocks()))
                ys.append(y)
                ps.append(np.r_[-1, y[page.parent[1:]]])
    w, pair = prior.copy(), np.array([[1.0, -1.0], [-1.0, 1.0]])
    if xs:
        x, y, p = np.concatenate(xs), np.concatenate(ys), np.concatenate(ps)
        for _ in range(200):
            tie = np.where(p == 1, pair[1, 1] - pair[1, 0], np.where(p == 0, pair[0, 1] - pair[0, 0], 0))
            error = y - 1 / (1 + np.exp(-np.clip(x @ w + tie, -30, 30)))
            w += 0.5 * (x.T @ error / len(y) - 0.002 * (w - prior))
            for k in (0, 1):
                g = 0.5 * error[p == k].sum() / len(y)
                pair[k, 1] += g / 2
                pair[k, 0] -= g / 2
    return w, pair


def main_text(source: str | None, w: np.ndarray, pair: np.ndarray) -> str:
    if not source:
        return ""
    page = Page(source)
    blocks = page.blocks()
    keep = marginals(page.parent, page.features(blocks) @ w, pair) > 0.5
    return " ".join(text for node, text, _ in blocks if keep[node])


def extract(pages: DataFrame, max_pages: int = MAX_PAGES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    n = rows.count()
    rate = min(1.0, max_pages / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < rate * 1_000_000).select("page_id", "html").limit(2 * max_pages)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, pair = train([h for b in batches for h in b.column("html").to_pylist() if h])
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()]), pa.array([pair.ravel().tolist()])], ["w", "pair"])

    found = sample.repartition(1).mapInArrow(learn, "w array<double>, pair array<double>").first()
    w, pair = (np.array(found["w"]), np.array(found["pair"]).reshape(2, 2)) if found else train([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, w, pair) for h in sliced(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
