"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams the events of a page into lines, one for each block, with their characters,
tags and characters inside links. What can never be article text (menus, headers and footers of the page, sidebars,
forms, notices, adverts, comments, scripts, styles) is left out by element, role or class as it streams by. Each
line has a ratio of text outside links to tags; ratios are smoothed with a Gaussian and split into two clusters by
the threshold that separates them best. Content regions are then selected: ``article`` and ``main`` elements whose
lines reach the threshold on average (at least the best of them). Inside them a run of lines of the lower cluster
leaves when half of its characters or more are links (lists of further pages, tags, shares); short text of the
article is low as well, but not made of links. On a page without regions, the lines of the upper cluster are
selected, with short lines between two of them and headings just before one.

Pages are scanned in place, whole, in Arrow batches; nothing is shuffled. Broken markup never raises: odd
declarations are comments, an open comment hides the rest, open elements end where a browser ends them.

Defined cases: a null or empty page, or one without text, has the empty text. Repeated rows, null ids and urls are
rows like any other; an empty table gives an empty result. Extra columns are left out by name.
"""

from __future__ import annotations

import math
import re
import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeframe.operators.extract import OpenElements

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIGMA = 1.5
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
OUT = frozenset(
    "nav footer aside form script style noscript template iframe object button select textarea svg canvas dialog menu head audio video".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
# names of page furniture; LAYOUT also as the first part of a longer name where a page has no region around it
LAYOUT = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent popup modal newsletter sharing comment comments commentlist disqus widget toolbar".split()
)
NAMES = LAYOUT | frozenset(
    "promotion notice notices overlay subscribe signup share social related recommended recommendations reply replies respond login search skip".split()
)
# second parts that leave no doubt about any of the names, and those that leave none about the plainer ones
PARTS = frozenset("ads articles banner bar box buttons form icons items links list modal popup posts widget".split())
PLAIN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent newsletter comment comments commentlist disqus reply replies respond".split()
)
PLAIN_PARTS = PARTS | frozenset("area author block body card container content count inner meta notice section sections signup text thread title wrap wrapper".split())
HOLDERS = frozenset("article div section ol ul".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("ul ol dl table article main section div body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
AS_TEXT = frozenset("title textarea iframe noembed noframes xmp".split())
_COMMENT_AT_ONCE, _COMMENT_END = re.compile("-?>"), re.compile("--!?>")


def _furniture(name: str, region) -> bool:
    """Whether a class names page furniture: whole, or by a first part that its other parts bear out."""
    first, *parts = name.replace("_", "-").split("-")
    if name in NAMES:
        return not (region and name == "header")
    if first in LAYOUT and not region:
        return True
    parts = set(parts)
    return bool(parts) and (first in NAMES and parts <= PARTS or first in PLAIN and parts <= PLAIN_PARTS)


def _named_out(tag, attrs, region) -> bool:
    """Whether role, class or id say that an element is no article text.

    Ids are often made from headings, so they count whole only, and inside a region only for holders of comments. A class
    header is the article's own inside a region. Headings have text.
    """
    for key, value in attrs:
        if key == "role" and value and value.strip().lower() in ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and value and tag not in HEADINGS:
            for name in value.lower().split():
                if key == "class" and _furniture(name, region):
                    return True
                if key == "id" and (name in COMMENTS and tag in HOLDERS if region else name in NAMES):
                    return True
    return False


class Lines(HTMLParser):
    """Events of one page as lines [text, tags, characters in links, region, heading]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.text, self.tags, self.linked = [], [], 0, 0
        self.elements = OpenElements()
        self.stack = self.elements.stack
        self.regions, self.links, self.heading = 0, 0, False

    def updatepos(self, i, j):
        return j

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def parse_comment(self, i, report=1):
        """A comment of normal content ends as in a browser, an open one with the page; elsewhere its mark is text."""
        if self.stack and self.stack[-1]["tag"] in AS_TEXT:
            self.handle_data("<!--")
            return i + 4
        end = _COMMENT_AT_ONCE.match(self.rawdata, i + 4) or _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def _state(self):
        return (self.stack[-1]["out"], self.stack[-1]["region"]) if self.stack else (False, 0)

    def _line(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self._state()[1], self.heading))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._line()
            self._imply(tag)
        out, region = self._state()
        if not out:
            self.tags += 1
            if tag == "br":
                self.text.append(" ")
        if tag in VOID:
            return
        if not out and tag not in ("html", "body"):
            out = tag in OUT or tag == "header" and not region or _named_out(tag, attrs, region or tag in ("article", "main"))
        if tag in ("article", "main") and not out and not region:
            self.regions += 1
            region = self.regions
        self.elements.push({"tag": tag, "out": out, "region": region})
        self.links += tag == "a"
        if tag in HEADINGS:
            self.heading = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _imply(self, tag):
        """End what a browser ends before this block: an open paragraph, an earlier item of the same list."""
        ends = {"p", *CLOSES.get(tag, ())}
        while (k := self.elements.nearest(ends)) > self.elements.nearest(FENCE):
            name = self.stack[k]["tag"]
            self._pop(k)
            if name != "p":
                return

    def _pop(self, k):
        while len(self.stack) > k:
            name = self.elements.pop()["tag"]
            self.links -= name == "a"
            if name in HEADINGS:
                self.heading = False

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._line()
        k = self.elements.nearest((tag,))
        if k < 0 or tag not in BLOCK and self.elements.nearest(("td", "th", "table")) > k:
            return
        if not self.stack[k]["out"]:
            self.tags += 1
        self._pop(k)

    def handle_data(self, data):
        if not self._state()[0]:
            self.text.append(data)
            if self.links:
                self.linked += len(data)

    def done(self):
        self.close()
        self._line()
        return self.lines


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is cut and normed."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[low:high], strict=True)) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Cut between two clusters of values: least spread inside them, but no higher than one standard deviation.

    On a page that is all content the values form one cluster far above their deviation, and all of it stays.
    """
    ordered = sorted(values)
    n, total = len(ordered), sum(ordered)
    best, cut, left = -1.0, ordered[0], 0.0
    for k in range(1, n):
        left += ordered[k - 1]
        between = k * (n - k) * (left / k - (total - left) / (n - k)) ** 2
        if ordered[k] > ordered[k - 1] and between > best:
            best, cut = between, (ordered[k] + ordered[k - 1]) / 2
    return min(cut, math.sqrt(sum((v - total / n) ** 2 for v in ordered) / n))


def _links(lines) -> bool:
    """Whether links make up half of the characters of lines or more."""
    return 2 * sum(line[2] for line in lines) >= sum(len(line[0]) for line in lines)


def _of_the_article(own: list[int], lines, raw: list[float], ratio: list[float], cut: float) -> list[int]:
    """The lines of a region without runs of the lower cluster that links make up, and link lines next to those."""
    gone, at = set(), 0
    while at < len(own):
        to = at + 1
        low = ratio[own[at]] < cut
        while to < len(own) and (ratio[own[to]] < cut) == low:
            to += 1
        if low and _links([lines[i] for i in own[at:to]]):
            for k, step in ((at - 1, -1), (to, 1)):
                while 0 <= k < len(own) and raw[own[k]] < cut and _links([lines[own[k]]]):
                    gone.add(own[k])
                    k += step
            gone.update(own[at:to])
        at = to
    return [i for i in own if i not in gone]


def extract(html: str | None) -> str:
    """Main text of a whole page, one line for each block."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = parser.done()
    if not lines:
        return ""
    raw = [max(len(t) - linked, 0) / max(tags, 1) for t, tags, linked, *_ in lines]
    ratio = smooth(raw)
    cut = threshold(ratio)
    means: dict[int, list[float]] = {}
    for (*_, region, _), r in zip(lines, ratio, strict=True):
        if region:
            means.setdefault(region, []).append(r)
    if means:
        mean = {k: sum(v) / len(v) for k, v in means.items()}
        top = max(mean.values())
        chosen = {k for k, m in mean.items() if m >= min(cut, top)}
        own = [i for i, line in enumerate(lines) if line[3] in chosen]
        return "\n".join(lines[i][0] for i in _of_the_article(own, lines, raw, ratio, cut))
    keep = [r >= cut for r in ratio]
    for i, line in enumerate(lines):
        if not keep[i] and i + 1 < len(lines) and keep[i + 1] and (line[4] or i and keep[i - 1]):
            keep[i] = True
    return "\n".join(line[0] for line, k in zip(lines, keep, strict=True) if k)


@F.arrow_udf(T.StringType())
def _extracted(pages: pa.Array) -> pa.Array:
    return pa.array([extract(p.as_py()).encode("utf-8", "replace").decode() for p in pages], pa.string())


def main_text(html: Column) -> Column:
    """Main text of each page; empty if there is none."""
    return _extracted(html)
