"""Page feature extraction: one Arrow pass over the html column.

This is the only place where rows reach Python. The scan keeps raw parts only (texts, counts, link
parts, JSON-LD nodes); urls, flags, signals and rules are native columns built on top of it.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from citeframe.schemas import schema

# The scan travels to the workers with the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: element groups of html
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEAD_ONLY = frozenset("title meta link base script style noscript template head html".split())
AS_TEXT = frozenset("title textarea iframe noembed noframes xmp".split())
UNSEEN = frozenset(["script", "style", "noscript", "template"])
OFF_PAGE_TEXT = frozenset(["script", "style", "pre", "code"])
CONTAINERS = frozenset("section article main header nav div body".split())
BLOCKS = frozenset(["li", "p", "td", "th"])
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
}

_COMMENT_AT_ONCE, _COMMENT_END = re.compile("-?>"), re.compile("--!?>")


class OpenElements:
    """Stack of open elements that knows where the elements of each name are, so no end tag walks the stack."""

    def __init__(self) -> None:
        self.stack: list[dict] = []
        self.places: dict[str, list[int]] = {}

    def push(self, el: dict) -> None:
        self.places.setdefault(el["tag"], []).append(len(self.stack))
        self.stack.append(el)

    def pop(self) -> dict:
        el = self.stack.pop()
        self.places[el["tag"]].pop()
        return el

    def nearest(self, names) -> int:
        """Place of the innermost open element with one of the names, -1 without any."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)


# Links show at most 180 characters of a text; this many are kept of a longer one.
SHOWN = 400


def enough(text: str, start: int, end: int) -> str:
    """As much of a slice as holds ``SHOWN`` characters once tags and repeated white space are out."""
    size = 1024
    while end - start > size:
        part = text[start : start + size]
        tag = part.find("<", part.rfind(">") + 1)
        if tag >= 0:
            part = part[:tag]
        if len(" ".join(re.sub("<[^>]+>", " ", part).split())) > SHOWN:
            return part
        size *= 4
    return text[start:end]


class PageScan(HTMLParser):
    """Collects the parts of one page in a single walk over its tags, in time that grows with its length.

    Texts of headings, links and blocks are noted as places in the body text and cut out once at the end.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.body: list[str] = []  # visible text pieces, in order
        self.length = 0  # of the visible text so far
        self.elements = OpenElements()
        self.open = self.elements.stack
        self.headed = 0  # open elements, from the outermost on, that hold a heading
        self.marks = {"unseen": 0, "off_page": 0}
        self.in_body = False
        self.title: list[str] | None = None
        self.title_done = False
        self.title_text = ""
        self.site: list[str] = []
        self.headings: list[tuple[str, int, int]] = []
        self.links: list[dict] = []
        self.count = dict.fromkeys(["lists", "tables", "scripts", "controls", "aria", "h1"], 0)
        self.script: list[str] | None = None
        self.jsonld: list[str] = []
        self.metas: list[dict] = []
        self.alternates: list[dict] = []
        self.canonical: str | None = None
        self.refresh: str | None = None
        self.root = {"tag": "body", "first": None, "direct": None, "outer": None}
        self.said: dict[tuple[int, int], str] = {}  # texts of blocks by place, as all links of a block share its text

    def updatepos(self, i, j):
        """Line numbers are never asked for, so they are not counted."""
        return j

    def parse_marked_section(self, i, report=1):
        """A declaration that html does not know is a comment."""
        return self.parse_bogus_comment(i)

    def parse_comment(self, i, report=1):
        """A comment of normal content ends as in a browser, an open one with the page; elsewhere its mark is text."""
        if self.open and self.open[-1]["tag"] in AS_TEXT:
            self.handle_data("<!--")
            return i + 4
        end = _COMMENT_AT_ONCE.match(self.rawdata, i + 4) or _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    # ---- tags ----
    def handle_starttag(self, tag, attrs):
        at: dict[str, str] = {}
        for key, value in attrs:
            at.setdefault(key, value or "")
        if tag == "body" or (tag not in HEAD_ONLY and not self.in_body):
            self.in_body = True
        if tag in ("body", "html", "head"):
            return
        if tag in CLOSES_P:
            self._close({"p"}, stop=BLOCKS - {"p"} | {"table"})
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        self._tally(tag, at)
        if tag in VOID:
            return
        el = {"tag": tag, "start": self.length, "first": None, "direct": None, "link": None}
        if tag in CONTAINERS:
            outer = self.elements.nearest(CONTAINERS)
            el["outer"] = self.open[outer] if outer >= 0 else self.root
        if tag == "a" and "href" in at:
            el["link"] = self._start_link(at)
        if tag == "title" and not self.title_done:
            self.title = []
        if tag == "script":
            self.script = [] if at.get("type") == "application/ld+json" else None
        self.marks["unseen"] += tag in UNSEEN
        self.marks["off_page"] += tag in OFF_PAGE_TEXT
        self.elements.push(el)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._pop_to(self.elements.nearest((tag,)))

    def _pop_to(self, depth):
        while depth >= 0 and len(self.open) > depth:
            self._end(self.elements.pop())
            self.headed = min(self.headed, len(self.open))

    def handle_data(self, data):
        if self.title is not None:
            self.title.append(data)
        if self.script is not None:
            self.script.append(data)
        if not self.marks["off_page"]:
            self.site.append(data)
        inside_head = self.title is not None or not self.in_body
        if not self.in_body and data.strip() and self.title is None and not self.marks["unseen"]:
            self.in_body, inside_head = True, False
        if not inside_head and not self.marks["unseen"]:
            self.body.append(data)
            self.length += len(data)

    # ---- parts ----
    def _close(self, tags, stop=frozenset()):
        depth = self.elements.nearest(tags)
        if depth > self.elements.nearest(stop):
            self._pop_to(depth)

    def _end(self, el):
        tag = el["tag"]
        if tag in ("h1", "h2", "h3"):
            self._end_heading(tag, el["start"])
        elif tag == "title":
            self.title_text, self.title_done, self.title = "".join(self.title or []), True, None
        elif tag == "script" and self.script is not None:
            self.jsonld.append("".join(self.script))
            self.script = None
        if el["link"] is not None:
            el["link"]["text"] = (el["start"], self.length)
        if "waiting" in el:
            for link in el["waiting"]:
                link["block"] = (el["start"], self.length)
        self.marks["unseen"] -= tag in UNSEEN
        self.marks["off_page"] -= tag in OFF_PAGE_TEXT

    def _end_heading(self, tag, start):
        place = (start, self.length)
        self.headings.append((tag, *place))
        parent = self.open[-1] if self.open else self.root
        if parent["direct"] is None:
            parent["direct"] = place
        for holder in [self.root, *self.open[self.headed :]]:
            if holder["first"] is None:
                holder["first"] = place
        self.headed = len(self.open)

    def _start_link(self, at):
        link = {"href": at["href"], "aria": at.get("aria-label"), "title": at.get("title"), "block": None, "text": (0, 0)}
        holder = self.elements.nearest(CONTAINERS)
        link["around"] = self.open[holder] if holder >= 0 else self.root
        block = self.elements.nearest(BLOCKS)
        if block >= 0:
            self.open[block].setdefault("waiting", []).append(link)
        self.links.append(link)
        return link

    def _tally(self, tag, at):
        n = self.count
        n["lists"] += tag in ("ul", "ol")
        n["tables"] += tag == "table"
        n["scripts"] += tag == "script"
        n["h1"] += tag == "h1"
        control = tag in ("button", "input", "textarea", "select") or at.get("role") == "button"
        n["controls"] += control
        n["aria"] += control and "aria-label" in at
        if tag == "meta":
            name = at.get("property") or at.get("name")
            if name and "content" in at:
                self.metas.append({"name": name, "content": at["content"]})
            if at.get("http-equiv", "").strip().lower() == "refresh" and self.refresh is None:
                self.refresh = at.get("content", "")
        elif tag == "link" and at.get("rel") == "canonical" and self.canonical is None and "href" in at:
            self.canonical = at["href"].strip()
        elif tag == "link" and at.get("rel") == "alternate" and "hreflang" in at:
            self.alternates.append({"hreflang": at["hreflang"].strip(), "href": at.get("href", "").strip()})

    # ---- result ----
    def parts(self) -> dict:
        self._pop_to(0)
        if self.title is not None:
            self.title_text = "".join(self.title)
        self.text = "".join(self.body)
        headings = [(tag, self.text[start:end].strip()) for tag, start, end in self.headings]
        first_h1 = next((t for tag, t in headings if tag == "h1"), "")
        meta = {m["name"]: m["content"] for m in reversed(self.metas)}
        nodes, depths, invalid = jsonld_nodes(self.jsonld)
        robots = " ".join(meta[k] for k in ("robots", "googlebot") if meta.get(k))
        return {
            "title": self.title_text.strip(),
            "meta_description": meta.get("description", "").strip(),
            "h1": first_h1,
            "h1_count": self.count["h1"],
            "headings": [t for tag, t in headings if tag != "h1" and t],
            "lists": self.count["lists"],
            "tables": self.count["tables"],
            "scripts": self.count["scripts"],
            "canonical": self.canonical,
            "robots_meta": robots.lower(),
            "aria_controls": self.count["aria"],
            "controls": self.count["controls"],
            "refresh": self.refresh,
            "body_text": " ".join(self.text.split()),
            "site_text": " ".join("".join(self.site).split()),
            "raw_links": [self._link(link) for link in self.links],
            "jsonld_nodes": nodes,
            "jsonld_depths": depths,
            "jsonld_invalid": invalid,
            "metas": self.metas,
            "alternates": self.alternates,
        }

    def _said(self, place) -> str | None:
        return None if place is None else enough(self.text, *place)

    def _heading(self, holder) -> str | None:
        """Nearest container with a heading wins: its own child heading first, then any inside it."""
        passed, found = [], None
        while holder is not None and "heading" not in holder:
            passed.append(holder)
            texts = (self._said(holder[kind]) for kind in ("direct", "first"))
            found = next((t for t in texts if t and t.strip()), None)
            holder = None if found else holder["outer"]
        found = found or (holder["heading"] if holder is not None else None)
        for seen in passed:
            seen["heading"] = found
        return found

    def _link(self, link) -> dict:
        out = {k: link[k] for k in ("href", "aria", "title")}
        place = link["block"]
        if place is not None and place not in self.said:
            self.said[place] = self._said(place)
        return out | {"text": self._said(link["text"]), "block": self.said.get(place), "heading": self._heading(link["around"])}


def _no_constant(name):
    raise ValueError(name)


def jsonld_nodes(blocks: list[str]) -> tuple[list[str], list[int], int]:
    """Objects of all JSON-LD blocks with their depth; ``@graph`` children follow their level."""
    nodes, depths, invalid = [], [], 0
    for block in blocks:
        if not block.strip():
            continue
        try:
            parsed = json.loads(block, parse_constant=_no_constant)
        except (ValueError, RecursionError):
            invalid += 1
            continue
        level, depth = parsed if isinstance(parsed, list) else [parsed], 0
        while level:
            level = [node for node in level if isinstance(node, dict)]
            nodes += [_valid(json.dumps(node, ensure_ascii=False)) for node in level]
            depths += [depth] * len(level)
            graphs = [node.get("@graph") for node in level]
            level = [child for g in graphs for child in (g if isinstance(g, list) else [g])]
            depth += 1
    return nodes, depths, invalid


def _valid(text: str) -> str:
    """Half of a surrogate pair, which no encoding holds, becomes a question mark."""
    return text.encode("utf-8", "replace").decode()


def scan_page(html: str | None) -> dict:
    scan = PageScan()
    scan.feed(html or "")
    scan.close()
    return scan.parts()


# A portion of pages that is scanned and sent off at once ends with this many rows or bytes of html, and before that once
# its parts have this many characters: links repeat the texts around them.
PORTION_ROWS, PORTION_BYTES, PORTION_PARTS = 256, 1 << 21, 1 << 22


def portions(html: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of neighbouring pages; a large page makes a portion of its own."""
    start, held = 0, 0
    for at, size in enumerate(pc.fill_null(pc.binary_length(html), 0).to_pylist()):
        if at > start and (at - start >= PORTION_ROWS or held + size > PORTION_BYTES):
            yield start, at - start
            start, held = at, 0
        held += size
    if len(html) > start:
        yield start, len(html) - start


def characters(part) -> int:
    """Characters of all texts inside a part, repeats counted."""
    if isinstance(part, str):
        return len(part)
    if isinstance(part, dict):
        part = part.values()
    elif not isinstance(part, list):
        return 0
    return sum(map(characters, part))


def scanned(html: pa.Array, keep_site_text: bool = False) -> Iterator[tuple[int, list[dict]]]:
    """(start, parts) of neighbouring pages, no more at once than a portion or one page over ``PORTION_PARTS``."""
    for start, size in portions(html):
        rows, held = [], 0
        for value in html.slice(start, size):
            row = scan_page(value.as_py())
            if not keep_site_text:
                row["site_text"] = None
            held += characters(row)
            rows.append(row)
            if held > PORTION_PARTS:
                yield start, rows
                start, rows, held = start + len(rows), [], 0
        if rows:
            yield start, rows


def spread(pages_raw: DataFrame) -> DataFrame:
    """The same rows, dealt evenly over tasks of moderate size.

    One row group of a Parquet file is read by one task, and a few files make few tasks, so the scan and all that follows
    it would take as long as the largest of them. Rows are dealt by their place in the input, which no site, url or
    text can make uneven; adaptive execution sets the number of tasks by size.
    """
    return pages_raw.withColumn("_place", F.monotonically_increasing_id()).repartition(F.col("_place")).drop("_place")


def extract_pages(pages_raw: DataFrame, keep_site_text: bool = False) -> DataFrame:
    """Raw parts of every page; the html column ends here.

    ``site_text`` (all text but scripts, styles and code) is only filled on request because it
    repeats most of ``body_text``. Parts of a few pages at a time are held as Python objects, however many rows the
    session puts into an Arrow batch.
    """
    carried = StructType([f for f in pages_raw.schema.fields if f.name != "html"])
    parts = schema("page_parts")
    out_schema = StructType(carried.fields + parts.fields)
    arrow_parts = to_arrow_schema(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in scanned(batch.column("html"), keep_site_text):
                few = batch.slice(start, len(rows))
                found = pa.Table.from_pylist(rows, schema=arrow_parts)
                columns = [few.column(f.name) for f in carried.fields]
                columns += [column.combine_chunks() for column in found.columns]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out_schema.fields])

    ordered = pages_raw.select(*[f.name for f in carried.fields], "html")
    return ordered.mapInArrow(run, out_schema)
