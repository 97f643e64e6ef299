"""Locations of sitemap files: a pull tokenizer over stored xml, in one Arrow pass.

Tokens are taken from the front of the text one by one, each by one search, so that time grows with the file. Comments
and instructions are passed over, CDATA and entities give plain text, prefixes do not matter as long as a location has
the prefix of its entry, and a file that breaks off keeps what was complete before.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TAG = re.compile(r"""<(/?)([^\s<>/"']+)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>""")
_ENTITY = re.compile("&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);")
# marks that begin what is passed over, and their ends
_SKIPPED = (("<!--", "-->"), ("<?", "?>"))


def _plain(text: str) -> str:
    return _ENTITY.sub(lambda m: unescape(m[0]), text) if "&" in text else text


def tokens(xml: str):
    """(kind, value): text as it is meant, and the names of tags that open, close, or do both."""
    at = 0
    while (begin := xml.find("<", at)) >= 0:
        if begin > at:
            yield "text", _plain(xml[at:begin])
        skipped = next((s for s in _SKIPPED if xml.startswith(s[0], begin)), None)
        if skipped:
            end = xml.find(skipped[1], begin + len(skipped[0]))
            at = end + len(skipped[1])
        elif xml.startswith("<![CDATA[", begin):
            end = xml.find("]]>", begin)
            at = end + 3
            if end >= 0:
                yield "text", xml[begin + 9 : end]
        elif xml.startswith("<!", begin):
            inner, end = xml.find("[", begin), xml.find(">", begin)
            if 0 <= inner < end:
                end = xml.find("]>", inner)
                end += end >= 0
            at = end + 1
        else:
            tag = _TAG.match(xml, begin)
            if tag is None:
                return
            end, at = tag.end(), tag.end()
            yield "close" if tag[1] else "both" if tag[3].endswith("/") else "open", tag[2]
        if end < 0:
            return


def locations(xml: str | None) -> list[str]:
    """First location of each url entry, else of each sitemap entry, trimmed."""
    found: dict[str, list[str]] = {"url": [], "sitemap": []}
    entry, taken, inside, text = None, False, [], None
    held: Counter = Counter()  # open elements by name, so that a stray end tag costs nothing
    for kind, value in tokens(xml or ""):
        if kind == "text":
            if text is not None:
                text.append(value)
            continue
        prefix, _, name = value.rpartition(":")
        if kind == "open":
            if entry is None and name in found:
                entry, taken, inside = (name, prefix), False, []
                held.clear()
            elif entry is not None:
                if not inside and name == "loc" and prefix == entry[1] and not taken:
                    text = []
                inside.append(value)
                held[value] += 1
        elif kind == "close" and entry is not None:
            if held[value]:
                while (last := inside.pop()) != value:
                    held[last] -= 1
                held[value] -= 1
                if not inside and name == "loc" and text is not None:
                    found[entry[0]].append("".join(text).strip())
                    taken, text = True, None
            elif (name, prefix) == entry:
                entry, text = None, None
    return [x for x in found["url"] or found["sitemap"] if x]


@F.arrow_udf(ArrayType(StringType()))
def sitemap_locations(files: pa.Array) -> pa.Array:
    return pa.array([[x.encode("utf-8", "replace").decode() for x in locations(f.as_py())] for f in files], pa.list_(pa.string()))
