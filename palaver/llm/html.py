"""Main text of web pages by classifying flat text blocks.

A page becomes a flat list of blocks, the texts between block-level tags. A block is judged
by its word count and link density, those of the blocks before and after it, and whether the
elements around it are an article or named as boilerplate. The judge is a decision tree
grown from a small table of labelled pages (:data:`LABELLED`).
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.llm.common import arrow_schema, ship

ship(__name__)

MAIN_TEXT = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
)

# A tag ends at the first ">" outside a quoted value; a quote counts only after "=", and one that is
# never closed is a plain character. Every part is possessive, so that a page is read once.
_VALUE = r"\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[\s/=]++|[^\s/>=]++(?:{_VALUE})?+)*+)(?:>|\Z)"
    r"|</[^<>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# fixed values: elements whose content is no text of the page; of these, the ones whose content is no markup either
_SKIPPED = frozenset("script style title textarea noscript template iframe svg select object canvas audio video annotation annotation-xml".split())
_CODE = frozenset("script style".split())
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)|</{name}\Z", re.I) for name in _SKIPPED}

# fixed values: elements that end a block, that hold no content, and names of boilerplate
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del input picture source "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mstyle mpadded semantics".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SELF_CLOSING = frozenset("p li dt dd option tr td th thead tbody tfoot html body".split())
_BOILERPLATE_TAGS = frozenset("nav aside footer menu button dialog".split())
# Names of elements that are boilerplate with everything inside, and of elements that an article can stand in.
_FIRM_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar cookie cookies consent gdpr newsletter popup modal "
    "overlay comment comments respond replies disqus discussion related recommended complementary hidden paywall".split()
)
_SOFT_NAMES = frozenset(
    "banner menu nav navbar navigation breadcrumb breadcrumbs footer masthead notice notices subscribe subscription signup share sharing social widget "
    "toolbar pagination pager skip copyright login search toc contentinfo alert topbar bottombar".split()
)
# Parts of a name that say nothing about its kind, those that make it a frame of the page, and those that make it a state.
_PLACES = frozenset(
    "site main page top bottom left right primary secondary box block section area list item items link links bar unit slot text post posts article articles "
    "inner outer content contents body title header heading head form field group column col row panel image img icon icons button buttons small large id js the".split()
)
_FRAMES = frozenset("wrapper wrap container layout outer holder".split())
_STATES = frozenset("has have no not non with without is enabled disabled open closed off on hide show free".split())
_ARTICLE_NAMES = frozenset("article post entry story main content body text".split())
_STRONG_ARTICLE = frozenset("article story entry post".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


# How far an element and those inside are boilerplate: not, until an article begins, or altogether.
_NOT, _SOFT, _FIRM = 0, 1, 2


class _Blocks:
    """Collects the blocks of one page."""

    def __init__(self):
        # open elements: name, degree of boilerplate and whether in an article, both of all elements down to this one
        self.stack: list[tuple[str, int, bool]] = [("", _NOT, False)]
        self.opened: Counter[str] = Counter()
        self.blocks: list[list] = []
        self.parts: list[tuple[str, bool]] = []
        self.in_link = 0
        self.breaks = 0
        self.heading = False

    def text(self, raw: str) -> None:
        self.parts.append((html.unescape(raw) if "&" in raw else raw, self.in_link > 0))
        if not raw.isspace():
            self.breaks = 0

    def end_block(self) -> None:
        words = " ".join("".join(t for t, _ in self.parts).split())
        if words:
            count = len(words.split())
            linked = sum(len(t.split()) for t, link in self.parts if link)
            _, degree, article = self.stack[-1]
            self.blocks.append([words, count, min(1.0, linked / count), float(article and not degree), float(degree > 0), float(self.heading)])
        self.parts, self.breaks = [], 0

    def push(self, name: str, degree: int, article: bool) -> None:
        _, around, inside = self.stack[-1]
        if name in ("article", "main") and around == _SOFT:
            around = _NOT
        self.stack.append((name, max(around, degree), inside or article))
        self.opened[name] += 1

    def pop(self) -> None:
        self.opened[self.stack.pop()[0]] -= 1

    def open(self, name: str, attributes: str) -> None:
        if name == "a":
            self.in_link = 1
            return
        if name == "br":
            self.breaks += 1
            self.parts.append((" ", False))
            if self.breaks > 1:
                self.end_block()
            return
        degree, article = _kind(name, attributes)
        if name in _INLINE:
            if degree and name not in _VOID:
                self.end_block()
                self.push(name, degree, article)
            return
        self.end_block()
        if name in _HEADINGS:
            self.heading = True
        if name in _VOID:
            return
        if name in ("article", "main"):
            # an article does not stand in a paragraph or list item someone left open
            while self.stack[-1][0] in _SELF_CLOSING:
                self.pop()
        if name in _SELF_CLOSING and self.stack[-1][0] == name:
            self.pop()
        if name == "header" and not self.stack[-1][2]:
            degree = max(degree, _SOFT)
        self.push(name, degree, article)

    def close(self, name: str) -> None:
        if name == "a":
            self.in_link = 0
            return
        if name in _INLINE and not self.opened[name]:
            return
        self.end_block()
        if name in _HEADINGS:
            self.heading = False
        if self.opened[name]:
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()
            self.in_link = 0


def _named(token: str) -> int:
    """Degree of boilerplate that one class or id names.

    The last part that says more than a place decides, as in ``google-ads`` or
    ``comment-body``; ``copyright-law`` and states such as ``has-sidebar`` name none.
    """
    parts = [p.lower() for p in _WORD_PARTS.findall(token)]
    if not _STATES.isdisjoint(parts):
        return _NOT
    telling = [p for p in parts if p not in _PLACES and p not in _FRAMES]
    if not telling or telling[-1] not in _FIRM_NAMES and telling[-1] not in _SOFT_NAMES:
        return _NOT
    return _FIRM if telling[-1] in _FIRM_NAMES and _FRAMES.isdisjoint(parts) else _SOFT


def _kind(name: str, attributes: str) -> tuple[int, bool]:
    """How far an element is boilerplate by its name or attributes, and whether it is an article."""
    element = name in ("article", "main")
    degree, article = _FIRM if name in _BOILERPLATE_TAGS else _SOFT if name == "form" else _NOT, element
    if attributes and not attributes.isspace() and name not in ("body", "html"):
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "style":
                if "display:none" in value.replace(" ", "").lower():
                    degree = _FIRM
            elif key in ("hidden", "aria-hidden"):
                if value.lower() != "false":
                    degree = _FIRM
            elif key in ("class", "id", "role"):
                parts = {p.lower() for p in _WORD_PARTS.findall(value)}
                article |= bool(parts & _STRONG_ARTICLE) or parts <= _ARTICLE_NAMES and bool(parts)
                own = max(map(_named, value.split()), default=_NOT)
                # names around the text do not unmake an article, those of comments and adverts do
                degree = max(degree, own if not element else own if own == _FIRM and name == "article" else _NOT)
    return degree, article and not degree


def blocks(page: str | None) -> list[list]:
    """The blocks of a page: text, words, link density, in an article, in boilerplate, heading."""
    found, at = _Blocks(), 0
    page = page or ""
    unclosed: set[str] = set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            found.text(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name in _SKIPPED:
            if m["close"] or m[0].endswith("/>") or name in unclosed:
                continue
            end = _END[name].search(page, at)
            if end:
                at = end.end()
            elif name in _CODE:
                at = len(page)
            else:  # left open: what follows is the page
                unclosed.add(name)
        elif m["close"]:
            found.close(name)
        else:
            found.open(name, m["attributes"])
    if at < len(page):
        found.text(page[at:])
    found.end_block()
    return found.blocks


def rows_of(found: list[list]) -> list[tuple[float, ...]]:
    """Features of each block: its own words and link density, its neighbours', and what is around it."""
    edge = ["", 0, 0.0, 0.0, 0.0, 0.0]
    padded = [edge, *found, edge]
    return [
        (b[1], b[2], a[1], a[2], c[1], c[2], b[3], b[4], b[5], max(a[3], c[3]))
        for a, b, c in zip(padded, padded[1:], padded[2:])
    ]


# --- the tree ---


def grow(rows: list[tuple[float, ...]], labels: list[int], depth: int = 9):
    """A binary decision tree by Gini impurity: a class, or (feature, threshold, at most, above)."""
    positive = sum(labels)
    if depth == 0 or positive in (0, len(labels)):
        return int(positive * 2 > len(labels))
    best = None
    for f in range(len(rows[0])):
        ordered = sorted(zip((r[f] for r in rows), labels))
        left = 0
        for i in range(1, len(ordered)):
            left += ordered[i - 1][1]
            if ordered[i - 1][0] == ordered[i][0]:
                continue
            right = positive - left
            impurity = left * (i - left) / i + right * (len(ordered) - i - right) / (len(ordered) - i)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, (ordered[i - 1][0] + ordered[i][0]) / 2)
    if best is None:
        return int(positive * 2 > len(labels))
    _, f, threshold = best
    low = [i for i, r in enumerate(rows) if r[f] <= threshold]
    high = [i for i, r in enumerate(rows) if r[f] > threshold]
    return f, threshold, grow([rows[i] for i in low], [labels[i] for i in low], depth - 1), grow([rows[i] for i in high], [labels[i] for i in high], depth - 1)


def decide(tree, row: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


_S = "It was a long way from the harbour to the old town and the rain had not stopped since the morning of the day before."
_L = " ".join([_S] * 3)

# The labelled table: small pages, and for each of their blocks 1 for main text, 0 for the rest.
LABELLED: list[tuple[str, list[int]]] = [
    ("<nav><ul><li><a href=a>Home</a></li><li><a href=b>About us</a></li></ul></nav><article><h1>The harbour in the rain</h1><p>" + _L + "</p><p>Short end.</p><p>" + _S + "</p></article><footer>Copyright 2020 The harbour paper, all rights reserved</footer>", [0, 0, 1, 1, 1, 1, 0]),
    ("<div class=ad>" + _S + "</div><article><h1>Rain</h1><p>" + _S + "</p></article><footer>" + _S + "</footer>", [0, 1, 1, 0]),
    ("<article><h1>One</h1><p>Yes.</p><p>No.</p><p>" + _L + "</p></article>", [1, 1, 1, 1]),
    ("<article><p>See <a href=x>the first report on the harbour</a></p><p><a href=y>Second report</a></p><p>" + _S + "</p></article>", [1, 1, 1]),
    ("<article><h2>Title</h2><p>" + _S + "</p><aside><p>" + _L + "</p></aside><p>" + _S + "</p><form><p>Your mail</p></form></article>", [1, 1, 0, 1, 0]),
    ("<header><h1>The daily paper</h1><p>" + _S + "</p></header><main><h1>Rain</h1><p>" + _L + "</p></main>", [0, 0, 1, 1]),
    ("<div id=comments><h3>Comments</h3><p>" + _L + "</p><p>I do not think so</p></div>", [0, 0, 0]),
    ("<div class=cookie-notice><p>" + _S + "</p></div><div><h1>Rain again</h1><p>" + _L + "</p><p>" + _L + "</p></div>", [0, 1, 1, 1]),
    ("<div><a href=a>Home</a> <a href=b>News</a></div><div><h1>Harbour rain</h1><p>" + _L + "</p><p>But why?</p><p>" + _L + "</p></div><div><a href=c>Imprint</a></div>", [0, 1, 1, 1, 1, 0]),
    ("<p><a href=a>One</a></p><p><a href=a>Two three</a></p><p><a href=a>Four five six seven eight nine ten eleven twelve thirteen fourteen</a></p>", [0, 0, 0]),
    ("<ul><li><a href=a>Rain</a></li><li><a href=b>Sun</a></li></ul><p>" + _S + "</p><ul><li><a href=c>" + _S + "</a></li></ul>", [0, 0, 1, 0]),
    ("<p>Posted by admin</p><p>12 views</p><p>" + _L + "</p><p>" + _L + "</p><p>Print</p>", [0, 0, 1, 1, 0]),
    ("<p>" + _S + "</p>", [1]),
    ("<p>" + _L + "</p><p>" + _S + "</p><p>" + _L + "</p>", [1, 1, 1]),
    ("<p>All rights reserved</p>", [0]),
    ("<h1>Rain over the harbour</h1><p>" + _L + "</p><h2>Sun</h2><p>" + _L + "</p>", [1, 1, 1, 1]),
    ("<h3>Links</h3><p><a href=a>Rain</a></p><p><a href=a>Sun</a></p>", [0, 0, 0]),
    ("<article><footer>" + _S + "</footer></article>", [0]),
    ("<article><p>" + _L + "</p><div class=related><a href=a>More rain</a></div></article>", [1, 0]),
    ("<div class=sidebar><h2>Weather</h2><p>" + _L + "</p></div>", [0, 0]),
    ("<div><a href=a>Home</a> | <a href=b>News</a> | <a href=c>Sports</a> | <a href=d>Weather</a></div><p>" + _L + "</p>", [0, 1]),
    ("<div><a href=a>Home</a> - <a href=b>All the news</a> - <a href=c>Sports and leisure</a> - <a href=d>Weather</a></div><h1>Rain</h1><p>" + _L + "</p>", [0, 1, 1]),
    ("<p>" + _L + "</p><p>Copyright 2020 The harbour paper, all rights reserved</p>", [1, 0]),
    ("<p>" + _L + "</p><p>" + _L + "</p><div>Terms of use, contact, imprint and privacy policy</div>", [1, 1, 0]),
    ("<div>Sign up for our weekly letter today</div><h1>Rain over the harbour</h1><p>" + _L + "</p>", [0, 1, 1]),
    ("<p>" + _L + "</p><p>The rain went on and on.</p><p>" + _L + "</p>", [1, 1, 1]),
    ("<p>" + _L + "</p><p>Nobody knew where from, they said.</p><p>" + _S + "</p>", [1, 1, 1]),
    ("<p>" + _S + " See <a href=a>the first report on the harbour</a> or <a href=b>the second one</a>.</p><p>" + _L + "</p>", [1, 1]),
    ("<p>Follow the harbour paper on every channel</p><p><a href=a>One</a> <a href=b>Two</a></p>", [0, 0]),
    ("<p>Loading the page, please wait a moment</p>", [0]),
    ("<table><tr><td><a href=a>Rain</a></td><td>12 Jan</td></tr><tr><td><a href=b>Sun</a></td><td>13 Jan</td></tr></table>", [0, 0, 0, 0]),
    ("<article><ul><li>One</li><li>Two and three</li></ul><p>" + _L + "</p></article>", [1, 1, 1]),
    ("<article><p><a href=a>" + _S + "</a></p></article>", [1]),
    ("<h1>Rain and sun</h1><p>" + _S + "</p><p>" + _S + "</p>", [1, 1, 1]),
    ("<div><a href=a>Home</a> | <a href=b>News</a> | <a href=c>All</a></div><h1>Rain</h1><p>" + _S + "</p>", [0, 1, 1]),
    ("<h2>Harbour</h2><p>" + _S + "</p><h2>Old town</h2><p>" + _S + "</p>", [1, 1, 1, 1]),
    ("<p>By a reader</p><p>" + _S + "</p>", [0, 1]),
    ("<article><p>Short start.</p><p>" + _L + "</p></article>", [1, 1]),
    ("<main><p>By the river</p><p>" + _S + "</p></main>", [1, 1]),
    ("<article><p>Rain, they said, for days and days</p><p>" + _S + "</p></article>", [1, 1]),
    ("<nav><a href=a>Home</a></nav><article><p>So it rained.</p><p>" + _S + "</p><p>So it did</p></article>", [0, 1, 1, 1]),
    ("<div><a href=a>Home</a></div><article><p>So it rained for a week</p><p>" + _L + "</p></article><div>Views</div>", [0, 1, 1, 0]),
    ("<article><p><a href=a>Rain</a> in June</p><p>" + _S + "</p></article>", [1, 1]),
    ("<article><p>" + _S + "</p><p><a href=a>Rain</a></p><p><a href=b>Sun and rain</a></p></article>", [1, 1, 1]),
    ("<article><h1><a href=a>Rain</a></h1><p>" + _S + "</p></article>", [1, 1]),
    ("<div class='layout has-sidebar'><article><p>" + _S + "</p></article></div><div class=left-sidebar><p>" + _S + "</p></div>", [1, 0]),
    ("<div class='post comments-enabled'><p>" + _S + "</p><div class=comment-list><article class=comment-body><p>" + _S + "</p></article></div></div>", [1, 0]),
    ("<div id=main-menu-wrapper><ul><li>Rain</li></ul><main><p>" + _S + "</p></main></div>", [0, 1]),
]


def trained_tree():
    rows, labels = [], []
    for page, own in LABELLED:
        found = blocks(page)
        if len(found) != len(own):
            raise ValueError(f"{len(found)} blocks, {len(own)} labels: {page[:80]}")
        rows += rows_of(found)
        labels += own
    return grow(rows, labels)


def extract(page: str | None, tree) -> str:
    """Main text of one page, blocks joined by line feeds; empty if there is none."""
    found = blocks(page)
    return "\n".join(b[0] for b, row in zip(found, rows_of(found)) if decide(tree, row))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null or empty page has an empty text; pages are read whole, also when tags are left
    open or the page breaks off. Repeated rows stay repeated; other columns are dropped.
    """
    schema, tree = arrow_schema(MAIN_TEXT), trained_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, tree) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema
            )

    columns = [F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*columns).mapInArrow(run, MAIN_TEXT)
