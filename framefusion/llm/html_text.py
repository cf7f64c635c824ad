"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page once. A line is the text between two block boundaries; it carries its number of
tags and the element it stands in. The ratios of text to tags are smoothed with a Gaussian kernel and cut at a threshold taken
from their own spread. The region is the article or main element in the containers that hold nine tenths of the text above the
threshold; all of its lines are returned, short ones included, except those inside menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments. A page without such an element is its own region, as no other container shows where the
article ends; only lines of links before its first and after its last other line are left out, and of these not paragraphs and headings.

Defined results: a null or empty page gives an empty text; a page without markup is its own text; markup that is never closed ends
with the page; equal pages give equal texts; pages of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split())
CONTAINERS = frozenset("html body div section article main center table tbody tr td blockquote".split())
DROPPED = frozenset(
    "head title nav footer aside form script style noscript template iframe svg canvas object select button textarea dialog menu "
    "option math audio video".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - frozenset("br html body head title li option dt dd td th tr tbody thead tfoot".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar aside footer header masthead banner cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended "
    "pagination pager comment comments commentlist disqus respond reply replies discussion widget widgets toolbar copyright "
    "disclaimer skip".split())
NEUTRAL_PREFIXES = frozenset("with has no is without not".split())

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
SIGMA, SHARE = 1.5, 0.9


def is_dropped(tag: str, attrs: list, inside_article: bool) -> bool:
    """Does this element hold something other than the article?"""
    if tag in DROPPED:
        return True
    if tag == "header" and not inside_article:
        return True
    for key, value in attrs:
        if key in ("class", "id"):
            if tag in ("html", "body", "main") or inside_article and tag in ("header", "h1", "h2"):
                continue
            for name in (value or "").split():
                words = [w.lower() for w in _NAME.findall(name)]
                if words and words[0] not in NEUTRAL_PREFIXES and not DROPPED_NAMES.isdisjoint(words):
                    return True
        elif key == "role":
            if value and value.lower() in DROPPED_ROLES:
                return True
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class Lines(HTMLParser):
    """Collects lines and the tree of elements from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag_of, self.dropped = [-1], [""], [False]
        self.stack = [0]
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[tuple[int, str, int, int]] = []
        self.in_article = 0

    def end_line(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line and not self.dropped[self.stack[-1]]:
                self.lines.append((self.stack[-1], line, self.tags, self.linked))
            self.text = []
            self.tags = self.linked = 0

    def pop(self) -> None:
        tag = self.tag_of[self.stack.pop()]
        self.open[tag] -= 1
        if tag in ("article", "main"):
            self.in_article -= 1

    def close_open(self, tags: set[str], until: frozenset[str]) -> None:
        """Close an element of `tags` that is still open, if no element of `until` stands between."""
        if not any(self.open.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.tag_of[self.stack[i]]
            if tag in tags:
                while len(self.stack) > i:
                    self.pop()
                return
            if tag in until:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_line()
            if tag in CLOSES_P and self.open.get("p"):
                self.close_open({"p"}, CONTAINERS)
            if tag in SELF_CLOSING:
                self.close_open(SELF_CLOSING[tag], frozenset(("ul", "ol", "dl", "table")) if tag != "p" else CONTAINERS)
        self.tags += 1
        if tag in VOID:
            return
        here = self.stack[-1]
        self.parent.append(here)
        self.tag_of.append(tag)
        self.dropped.append(self.dropped[here] or is_dropped(tag, attrs, self.in_article > 0))
        self.stack.append(len(self.parent) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in ("article", "main"):
            self.in_article += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag not in VOID and self.open.get(tag):
            while True:
                last = self.tag_of[self.stack[-1]]
                if last in BLOCKS:
                    self.end_line()
                self.pop()
                if last == tag:
                    return

    def handle_data(self, data: str) -> None:
        if not self.dropped[self.stack[-1]]:
            self.text.append(data)
            if self.open.get("a"):
                self.linked += len(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is cut and rescaled."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        a, b = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[a - i + reach:b - i + reach]
        out.append(sum(map(float.__mul__, weights, values[a:b])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Where two clusters of the smoothed ratios part: their standard deviation, never above their mean."""
    mean = sum(values) / len(values)
    return min(mean, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)))


def main_text(html: str | None) -> str:
    """The text of the article in one page."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    if not page.lines:
        return ""
    ratios = smooth([len(text) / max(1, tags) for _, text, tags, _ in page.lines])
    cut = threshold(ratios)
    nodes = len(page.parent)
    mass = [0] * nodes
    for (node, text, _, linked), ratio in zip(page.lines, ratios):
        if ratio >= cut and 2 * linked < len(text):
            mass[node] += len(text)
    for node in range(nodes - 1, 0, -1):
        mass[page.parent[node]] += mass[node]
    total = mass[0]
    region = 0
    if total:
        for node in range(1, nodes):  # parents come before children
            if page.parent[node] == region and page.tag_of[node] in CONTAINERS and mass[node] >= SHARE * total:
                if page.tag_of[region] in ("article", "main") and page.tag_of[node] not in ("article", "main"):
                    continue
                region = node
    if page.tag_of[region] not in ("article", "main"):
        plain = [i for i, (_, text, _, linked) in enumerate(page.lines) if 2 * linked < len(text)]
        return " ".join(text for i, (node, text, _, _) in enumerate(page.lines)
                        if not plain or plain[0] <= i <= plain[-1] or page.tag_of[node] in PARAGRAPHS)
    inside = [False] * nodes
    inside[region] = True
    for node in range(region + 1, nodes):
        inside[node] = inside[page.parent[node]]
    return " ".join(text for node, text, _, _ in page.lines if inside[node])


def extract_main_text(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """One row per page: the key columns, `text` and its length `n_chars` in code points. Other columns are not carried."""
    picked = pages.select(*[pages[k].alias(f"k{i}") for i, k in enumerate(keys)], pages[html].alias("html"))
    schema = ", ".join(f"k{i} {picked.schema[i].dataType.simpleString()}" for i in range(len(keys)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(cell.as_py()) for cell in part.column(len(keys))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*part.schema.names[:-1], "text", "n_chars"])

    out = picked.mapInArrow(read, f"{schema}, text string, n_chars long")
    return out.toDF(*keys, "text", "n_chars")
