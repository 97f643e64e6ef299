"""URL expressions (native columns).

Comparable form: lower-case scheme and host, no default port, no fragment, no trailing slash, an
empty path written as ``/``, dot segments resolved and unsafe characters percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeframe.functions.text import let

_ORIGIN = "^([a-z]+://[^/?#]*)"
_WEB = "(?i)^https?://[^/?#\\s]+"
# urls that are in comparable form already; one match spares most urls the rewriting below
_PLAIN = "^https?://[a-z0-9.-]+(?:/|(?:/[A-Za-z0-9_~-][A-Za-z0-9._~-]*)+)$"
_UNSAFE = "[^\\x21-\\x7e]|[\"<>`{}]"
# fixed values: characters that stay as they are inside a path or a query
_KEPT = [
    ("%25", "%"), ("%2F", "/"), ("%3F", "?"), ("%3A", ":"), ("%40", "@"), ("%21", "!"), ("%24", "$"), ("%26", "&"),
    ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2B", "+"), ("%2C", ","), ("%3B", ";"), ("%3D", "="), ("%7E", "~"),
    ("%5B", "["), ("%5D", "]"), ("%7C", "|"), ("%5C", "\\"), ("%5E", "^"), ("%23", "#"),
]


def is_web_url(c: Column) -> Column:
    return F.coalesce(c.rlike(_WEB), F.lit(False))


def url_origin(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "^[A-Za-z]+://[^/?#]*", 0))


def url_host(c: Column) -> Column:
    """Host name without port or user part, lower case."""
    return F.lower(F.regexp_extract(c, "^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(c: Column) -> Column:
    """Path of an absolute url, ``/`` when it is empty or the url is not one."""
    path = F.regexp_extract(c, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return let(path, lambda p: F.when(F.length(p) > 0, p).otherwise(F.lit("/")))


def _encoded(c: Column) -> Column:
    """Percent-encode blanks, quotes, brackets and every non-ASCII character of path and query."""

    def encode(v: Column) -> Column:
        out = F.replace(F.url_encode(v), F.lit("+"), F.lit("%20"))
        for code, char in _KEPT[1:]:
            out = F.replace(out, F.lit(code), F.lit(char))
        return F.replace(out, F.lit("%25"), F.lit("%"))

    def split_origin(v: Column) -> Column:
        origin = F.regexp_extract(v, _ORIGIN, 1)
        return let(origin, lambda o: F.concat(o, encode(F.substr(v, F.length(o) + 1))))

    return F.when(c.rlike(_UNSAFE), split_origin(c)).otherwise(c)


def _without_dots(c: Column) -> Column:
    """Resolve ``.`` and ``..`` path segments."""

    def resolve(path: Column) -> Column:
        start = F.array().cast("array<string>")
        names = F.filter(
            F.split(path, "/"), lambda s, i: (i > 0) & (s != ".")
        )
        stack = F.aggregate(
            names,
            start,
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
                F.array_append(acc, s)
            ),
        )
        closing = F.when(path.rlike("/\\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.lit("/"), F.array_join(stack, "/"), closing)

    def rebuild(v: Column) -> Column:
        origin = F.regexp_extract(v, _ORIGIN, 1)
        path = F.regexp_extract(v, _ORIGIN + "([^?#]*)", 2)
        tail = F.regexp_extract(v, _ORIGIN + "[^?#]*(.*)$", 2)
        return F.concat(origin, resolve(path), tail)

    return F.when(c.rlike(_ORIGIN + "[^?#]*/\\.{1,2}(/|[?#]|$)"), rebuild(c)).otherwise(c)


def comparable_url(c: Column) -> Column:
    """Comparable form of a web url; anything else is returned unchanged."""

    def normal(v: Column) -> Column:
        bare = F.trim(F.regexp_replace(v, "#.*$", ""))
        origin = F.regexp_extract(bare, "^[A-Za-z]+://[^/?#]*", 0)
        out = let(bare, lambda b: F.concat(F.lower(origin), F.regexp_replace(b, "^[A-Za-z]+://[^/?#]*", "")))
        out = F.regexp_replace(out, "^(http://[^/?#]*):80(?=[/?#]|$)", "$1")
        out = F.regexp_replace(out, "^(https://[^/?#]*):443(?=[/?#]|$)", "$1")
        out = let(out, _without_dots)
        out = F.regexp_replace(out, _ORIGIN + "/*(?=\\?|$)", "$1/")
        out = F.regexp_replace(out, _ORIGIN + "(/[^?#]*[^/?#])/+(?=\\?|$)", "$1$2")
        return let(out, _encoded)

    return let(c, lambda v: F.when(v.rlike(_PLAIN) | ~is_web_url(v), v).otherwise(normal(v)))


def search_url(c: Column) -> Column:
    """Comparable form that also ignores the scheme and a leading ``www.``."""
    return F.regexp_replace(
        F.regexp_replace(comparable_url(c), "^http://", "https://"), "^https://(?:www\\.)?([^/?#]*?)(?::443)?(?=[/?#]|$)", "https://$1"
    )


def url_domain(c: Column) -> Column:
    """Host in lower case without ``www.``; a bare host is accepted."""
    absolute = F.when(F.startswith(F.lower(c), F.lit("http")), c).otherwise(F.concat(F.lit("https://"), c))
    host = let(absolute, url_host)
    named = let(host, lambda h: F.when(F.length(h) > 0, h).otherwise(F.lower(c)))
    return F.regexp_replace(named, "^www\\.", "")


def domain_in(domain: Column, root: Column) -> Column:
    """Equal to ``root`` or a subdomain of it."""
    return (domain == root) | F.endswith(domain, F.concat(F.lit("."), root))


def domain_in_any(domain: Column, roots: Column) -> Column:
    return F.coalesce(F.exists(roots, lambda r: domain_in(domain, r)), F.lit(False))


def absolute_url(base: Column, href: Column) -> Column:
    """Comparable url of ``href`` seen from page ``base``; NULL for fragments, mail and script links."""

    def resolve(h: Column) -> Column:
        origin = F.regexp_extract(base, "^[A-Za-z]+://[^/?#]*", 0)
        scheme = F.regexp_extract(base, "^[A-Za-z]+:", 0)
        path = F.regexp_extract(base, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
        folder = let(F.regexp_replace(path, "[^/]*$", ""), lambda f: F.when(F.length(f) > 0, f).otherwise(F.lit("/")))
        return (
            F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.rlike("^//"), F.concat(scheme, h))
            .when(h.rlike("^/"), F.concat(origin, h))
            .when(h.rlike("^\\?"), F.concat(origin, path, h))
            .otherwise(F.concat(origin, folder, h))
        )

    skipped = lambda h: (F.length(h) == 0) | h.rlike("^(#|mailto:|javascript:)")
    return let(href, lambda h: F.when(h.isNotNull() & ~skipped(h), comparable_url(resolve(F.trim(h)))))


def last_segment_text(c: Column) -> Column:
    """Readable last path segment of a url, ``home`` when there is none."""
    segment = F.regexp_extract(url_path(c), "([^/]+)/*$", 1)
    words = F.trim(F.regexp_replace(segment, "[-_]+", " "))
    return let(words, lambda w: F.when(F.length(w) > 0, w).otherwise(F.lit("home")))


def path_has_any(path_lower: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(path_lower, F.lit(word))
    return hit
