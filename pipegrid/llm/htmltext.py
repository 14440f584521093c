"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page's events; a line is the text between two block-level tags, and its
text-to-tag ratio is its number of characters over its number of tags (one at least); text inside links does not count.
Elements that are never part of an article by their tag, role, class or id (menus, headers and footers of the page,
sidebars, notices, adverts, forms, scripts, styles, comments) yield no lines. The ratios of the other lines are smoothed by
a Gaussian over neighbouring lines and parted into two clusters of values (one-dimensional 2-means on a logarithmic
scale); the threshold lies between the clusters. Neighbouring lines above the threshold are a region. A region takes in the
lines of its container (the innermost ``article``, ``main`` or, without these, sectioning element), so that short paragraphs and
headings inside an article stay. Pages whose lines are all of one container keep them all.

Inside a line character references are decoded and white space is one blank; lines are joined by one newline. Null is an
empty page, and a page without text has an empty text. Unclosed elements end where their parent does; markup that is no
tag is text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGMA = 1.0  #: of the smoothing, in lines
LINK_SHARE = 0.6  #: a line with more of its characters in links is navigation

# HTML's elements by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input button".split())
DROPPED = set("script style noscript template nav footer aside form select option textarea button iframe object svg canvas head title dialog menu audio video map datalist".split())
RAW = {"script", "style"}
ROOMS = {"article", "main"}
SECTIONS = {"section", "div", "td", "body"}
P_ENDS = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "note", "status", "toolbar"}
# Words in class and id names of page furniture.
FURNITURE = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer foot colophon masthead topbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist discussion disqus respond reply replies "
    "pagination pager toolbar search skip copyright legal disclaimer".split()
)
# Words that show a class name to be about the layout around content.
LAYOUT = {"wrap", "wrapper", "has", "with", "no", "article", "main", "layout", "page", "body", "entry", "content"}
SITE_HEADS = {"header", "siteheader", "pageheader", "topheader", "site-header", "page-header", "head"}
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class _Lines(HTMLParser):
    """Collects (text, characters in links, tags, container number) for every line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.stack: list[tuple[str, bool, int]] = []  # tag, dropped, container
        self.dropped = 0
        self.links = 0
        self.room = 0
        self.rooms = 0
        self.kinds = {0: 0}  # container number: 2 article or main, 1 section, 0 page
        self.text: list[str] = []
        self.linked = 0
        self.tags = 0

    def _break(self):
        line = _SPACE.sub(" ", "".join(self.text)).strip()
        if line:
            self.lines.append((line, self.linked, max(1, self.tags), self.room))
            self.tags = 0
        self.text.clear()
        self.linked = 0

    def _furniture(self, tag: str, attrs) -> bool:
        if tag in DROPPED:
            return True
        if tag == "header" and not any(t in ROOMS for t, _, _ in self.stack):
            return True
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if not value:
                continue
            if name == "role" and value.strip().lower() in DROPPED_ROLES:
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
            if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
                for part in value.lower().split():
                    words = _WORD.findall(part)
                    if not FURNITURE.isdisjoint(words) and LAYOUT.isdisjoint(words) or part in SITE_HEADS and tag != "h1":
                        return True
        return False

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag not in INLINE:
            self._break()
            if tag in P_ENDS:
                self._close_if_open("p", P_ENDS - {"p"})
            if tag == "li":
                self._close_if_open("li", {"ul", "ol", "menu"})
        if tag in VOID:
            return
        furniture = not self.dropped and self._furniture(tag, attrs)
        self.stack.append((tag, furniture, self.room))
        self.dropped += furniture
        self.links += tag == "a"
        if tag in ROOMS or tag in SECTIONS and self.kinds[self.room] < 2:
            self.rooms += 1
            self.room = self.rooms
            self.kinds[self.room] = 2 if tag in ROOMS else 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in RAW:
            self.handle_endtag(tag)

    def _close_if_open(self, tag: str, walls: set[str]):
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self._close(at)
                return
            if self.stack[at][0] in walls:
                return

    def _close(self, at: int):
        while len(self.stack) > at:
            tag, furniture, self.room = self.stack.pop()
            self.dropped -= furniture
            self.links -= tag == "a"

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self._break()
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self._close(at)
                return
            if tag in INLINE and self.stack[at][0] not in INLINE:
                return  # an inline end tag does not close blocks

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)
            if self.links:
                self.linked += len(data)

    def unknown_decl(self, data):
        pass

    def close(self):
        super().close()
        self._break()


def _threshold(values: list[float]) -> float:
    """The border between two clusters of values; below all of them if there is only one."""
    low, high = min(values), max(values)
    if high - low < 1e-9:
        return low
    for _ in range(50):
        border = (low + high) / 2
        under = [v for v in values if v <= border]
        over = [v for v in values if v > border]
        moved = (sum(under) / len(under), sum(over) / len(over))
        if moved == (low, high):
            break
        low, high = moved
    return (low + high) / 2


def _smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        first = max(0, i - reach)
        window = values[first : i + reach + 1]
        weights = kernel[first - i + reach : first - i + reach + len(window)]
        out.append(sum(a * b for a, b in zip(window, weights)) / sum(weights))
    return out


def extract(html: str | None) -> str:
    """The main text of one page."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    ratios = [math.log1p(max(0, len(text) - linked) / tags) for text, linked, tags, _ in lines]
    smoothed = _smooth(ratios)
    border = _threshold(smoothed)
    above = [s >= border for s in smoothed]
    rooms = {room for (_, _, _, room), chosen in zip(lines, above) if chosen}
    articles = {room for room in rooms if parser.kinds[room] == 2}
    if articles:
        rooms = articles
    kept = []
    for text, linked, _, room in lines:
        if room in rooms and (parser.kinds[room] == 2 or linked <= LINK_SHARE * len(text)):
            kept.append(text)
    return "\n".join(kept)


@F.pandas_udf(T.StringType())
def _extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([extract(p) for p in pages], dtype=object)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    return pages.select("page_id", "url", _extract("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
