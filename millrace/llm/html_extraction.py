"""Main text of web pages by text-to-tag ratios.

Parser events cut a page into lines at block elements. Each line has a ratio of
characters to tags; the ratios are smoothed with a Gaussian, and lines above one
standard deviation are content. The article with most of it and the articles
beside it, else the main element, else the smallest element that holds all
content and is no section, list, table or quotation, is the content region; the
region's lines are the text, short ones included. Around the deepest element with
most of the content, a plain division without content does not belong. Menus, notices, forms, adverts, comments and the like are recognised
by element and by name, and never belong to a region.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.shared import slices

# Elements and names.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "aside button canvas dialog fieldset footer form head iframe input label menu nav noscript object option script "
    "select style svg template textarea title video audio".split()
)
SKIPPED_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments "
    "consent contentinfo complementary cookie cookies copyright dialog disqus footer form gdpr header login masthead "
    "menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted "
    "promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe toolbar widget".split()
)
# Words that only say what kind of part an element is.
PLAIN_NAMES = frozenset(
    "area bar block body bottom box btn button buttons card container content entries entry group icons inner item items "
    "label left line link links list module outer panel post posts right row section slot text thread top unit wrap wrapper zone".split()
)
NAME_ATTRIBUTES = ("class", "id", "role")
# Parts of a text, not the whole of it.
NO_REGION = frozenset("p li h1 h2 h3 h4 h5 h6 section blockquote ul ol dl dt dd table tbody thead tfoot tr pre figure figcaption details hgroup".split())
CLOSED_BY_BLOCK = frozenset(("p",))
CLOSED_BY_SAME = frozenset("li dd dt tr td th option".split())

# Smoothing of the ratios, in lines, and the share of the content that the region's core must hold.
SIGMA = 1.0
HELD = 0.7

NAME = re.compile("[a-z0-9]+")
CUT_TAG = re.compile(r"<[/!]?[A-Za-z-][^<>]*\Z")


def says_furniture(name: str) -> bool:
    """Whether a name says nothing else: ``share-buttons`` and ``ad-2`` do, ``share-price`` and ``ad-hoc-networks`` do not."""
    words = [w for w in NAME.findall(name) if not w.isdigit()]
    return not SKIPPED_NAMES.isdisjoint(words) and all(w in SKIPPED_NAMES or w in PLAIN_NAMES for w in words)


class Element:
    __slots__ = ("tag", "parent", "skipped", "named", "furniture", "chars", "content", "holds_main", "in_article", "left_out", "in_region", "apart")

    def __init__(self, tag: str, parent: Element | None, skipped: bool, named: bool, furniture: bool = False):
        self.tag, self.parent, self.skipped, self.named, self.furniture = tag, parent, skipped, named, furniture
        self.chars = self.content = 0
        self.holds_main = self.in_article = self.left_out = self.in_region = self.apart = False


class Lines(HTMLParser):
    """Collects lines as (text, number of tags, element) from parser events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", None, False, False)
        self.elements = [self.root]
        self.lines: list[tuple[str, int, Element]] = []
        self.parts: list[str] = []
        self.tags = 0

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.at))
            self.parts = []
        self.tags = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_line()
            while self.at.tag in CLOSED_BY_BLOCK and tag != "br":
                self.at = self.at.parent
            if tag in CLOSED_BY_SAME and self.at.tag == tag:
                self.at = self.at.parent
        self.tags += 1
        if tag in VOID:
            return
        skipped, named, furniture = tag in SKIPPED, False, False
        for name, value in attrs:
            if name in NAME_ATTRIBUTES and value:
                if not SKIPPED_NAMES.isdisjoint(NAME.findall(value.lower())):
                    named = True
                    furniture |= any(map(says_furniture, value.lower().split()))
            elif name == "hidden" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
                skipped = True
        if tag == "header":
            named = furniture = True
        if tag in BLOCKS or skipped or named:
            if tag not in BLOCKS:
                self.end_line()
            self.at = Element(tag, self.at, skipped, named and tag not in ("html", "body"), furniture)
            self.elements.append(self.at)
            if tag in ("article", "main"):
                up = self.at.parent
                while up is not None and not up.holds_main:
                    up.holds_main, up = True, up.parent

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        open_ = self.at
        while open_.parent is not None and open_.tag != tag:
            open_ = open_.parent
        if open_.parent is not None and tag not in VOID:
            self.end_line()
            self.at = open_.parent

    def handle_data(self, data: str) -> None:
        if self.at.tag not in ("script", "style"):
            self.parts.append(data)

    def close(self) -> None:
        super().close()
        self.end_line()


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(values)), kernel)[reach:-reach]
    return np.convolve(values, kernel)[reach:-reach] / weights


def _add_up(elements: list[Element], field: str) -> None:
    """Add each element's own count to all that hold it; elements come in the order they open."""
    for element in reversed(elements):
        if element.parent is not None:
            setattr(element.parent, field, getattr(element.parent, field) + getattr(element, field))


def _mark_left_out(elements: list[Element], total: int) -> None:
    """A name leaves an element out unless it holds the article, or most of a page without one; an article's own header stays.

    Inside an article only names that say nothing but furniture count.
    """
    for element in elements:
        up = element.parent
        if up is None:
            continue
        element.in_article = up.in_article or up.tag == "article"
        own_header = element.tag == "header" and element.in_article
        main = element.tag in ("article", "main") and not element.in_article
        # Without an article in the page, names alone may mislead.
        large = not elements[0].holds_main and element.tag != "header" and 2 * element.chars > total
        # An article's own sections are named after what they are about.
        told = element.furniture if element.in_article else element.named
        by_name = told and not (element.holds_main or main or own_header or large)
        element.left_out = up.left_out or element.skipped or by_name


def main_text(html: str) -> str:
    """The main text, one line per block; empty if there is none."""
    if not html:
        return ""
    parser = Lines()
    # The parser would report a tag that the end of the page cuts off as text.
    parser.feed(CUT_TAG.sub("", html))
    parser.close()
    elements = parser.elements
    for element in elements[1:]:
        element.skipped |= element.parent.skipped
    for text, _, element in parser.lines:
        element.chars += len(text)
    total = sum(len(text) for text, _, element in parser.lines if not element.skipped)
    _add_up(elements, "chars")
    _mark_left_out(elements, total)
    kept = [line for line in parser.lines if not line[2].left_out]
    if not kept:
        return ""
    ratios = smoothed(np.array([len(text) / max(1, tags) for text, tags, _ in kept]))
    threshold = min(ratios.std(), ratios.max())
    mass = 0
    for ratio, (text, _, element) in zip(ratios, kept):
        if ratio >= threshold:
            mass += len(text)
            element.content += len(text)
    _add_up(elements, "content")
    _mark_region(elements, mass)
    return "\n".join(text for text, _, element in kept if element.in_region and not element.apart)


def _mark_region(elements: list[Element], mass: int) -> None:
    for tag in ("article", "main"):
        best = max((e for e in elements if e.tag == tag and e.content), key=lambda e: e.content, default=None)
        if best is not None:
            _mark_joined(elements, best)
            break
    else:
        # Elements come in the order they open: the last one that holds enough is the deepest.
        held = [e for e in elements if e.tag not in NO_REGION]
        region = [e for e in held if e.content >= mass][-1]
        core = [e for e in held if e.content >= HELD * mass][-1]
        region.in_region = True
        inside = {core}
        for element in elements[1:]:
            if element in inside or element.parent in inside:
                inside.add(element)
            elif element.parent.in_region:
                element.apart = element.parent.apart or element.tag == "div" and not element.content
            element.in_region |= element.parent.in_region
        return
    for element in elements[1:]:
        element.in_region |= element.parent.in_region


def _mark_joined(elements: list[Element], best: Element) -> None:
    """The element with most content, and others of its kind beside it or with content, unless a name sets them apart."""
    around, up = set(), best.parent
    while up is not None:
        around.add(up)
        up = up.parent
    best.in_region = True
    others = []
    for element in elements[1:]:
        alike = element.tag == best.tag and not element.in_article
        # What stands in an article has been judged before.
        by_name = element.named and not element.in_article and element not in around and not (alike and best.named)
        element.apart = element.parent.apart or by_name
        if element is best:
            element.apart = False
        elif alike and not element.left_out and not element.apart and (element.content or element.parent is best.parent):
            others.append(element)
    for element in others:
        element.in_region = True
    if others and best.tag == "article":
        # What introduces several articles.
        for element in around:
            if element.tag == "main":
                element.in_region = True


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every page.

    One pass without a shuffle over whole pages. A null or empty page, or one
    without main text, gives an empty text; repeated rows are each answered.
    """
    rows = pages.select(F.col(key), F.col(url), F.col(html).alias("_html"))
    schema = rows.drop("_html").withColumns({"text": F.lit("").cast("string"), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(v) for v in batch.column(2).to_pylist()]
            data = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(data, schema.fieldNames())

    return rows.mapInArrow(run, schema)
