"""Text expressions (native columns)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: whitespace and word boundary spelled out, so the Java regex dialect does not matter
SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
ODD_SPACE = "[\\t\\n\\x0b\\f\\r\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
BLANKS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WORD_START, WORD_END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sql_string(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(values) -> Column:
    """Literal array, parsed as one expression."""
    return F.expr(f"cast(array({', '.join(sql_string(v) for v in values)}) as array<string>)")


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def squash(c: Column) -> Column:
    """Every run of whitespace becomes one blank; the ends are trimmed."""
    # single plain blanks are passed over, which most of a text is; the look-ahead rules out printable ASCII at once
    return F.trim(F.regexp_replace(c, f"(?=[^!-~])(?:{SPACE}{{2,}}|{ODD_SPACE})", " "))


def truncate(c: Column, n: int) -> Column:
    """Cut to ``n`` characters, the last three of them dots."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(trimmed(F.substring(c, 1, n - 3)), F.lit("...")))


def clean_text(c: Column, n: int = 180) -> Column:
    """Tags out, whitespace squashed, cut to ``n``; NULL when nothing is left."""
    squashed = squash(F.regexp_replace(c, "<[^>]+>", " "))
    return let(squashed, lambda s: F.when(F.length(s) > 0, truncate(s, n)))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def keyword_tokens(c: Column) -> Column:
    """Lower-case latin tokens of four or more characters, repeats kept."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 4)


def token_coverage(text_lower: Column, tokens: Column) -> Column:
    """Share of ``tokens`` found as substrings; 1.0 when there are no tokens."""
    hits = F.size(F.filter(tokens, lambda t: F.contains(text_lower, t)))
    return F.when(F.size(tokens) == 0, F.lit(1.0)).otherwise(hits.cast("double") / F.size(tokens))


def keyword_coverage(text_lower: Column, expected: Column) -> Column:
    """Share of the distinct keyword tokens of ``expected`` that occur in ``text_lower``."""
    return let(F.array_distinct(keyword_tokens(expected)), lambda tokens: token_coverage(text_lower, tokens))


def word_count(c: Column) -> Column:
    """Latin tokens, plus half the CJK characters rounded up."""
    latin = F.regexp_count(c, F.lit("[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*"))
    # the look-ahead passes over latin text without asking for scripts
    cjk = F.regexp_count(c, F.lit("(?=[^\\x00-\\u10ff])[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]"))
    return (latin + F.ceil(cjk / 2)).cast("int")


def term_hits(text_lower: Column, terms) -> Column:
    """The terms of a fixed vocabulary that occur in the text."""
    return F.filter(string_array(t.lower() for t in terms), lambda t: F.contains(text_lower, t))


def has_any(text_lower: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(text_lower, t))


def compact(values: Column, k: int = 3) -> Column:
    """First ``k`` distinct non-blank values, trimmed."""
    once = F.transform(F.array_distinct(values), trimmed)
    return F.slice(F.array_distinct(F.filter(once, lambda v: F.length(v) > 0)), 1, k)


def regex_examples(c: Column, pattern: str, k: int = 3) -> Column:
    return compact(F.regexp_extract_all(c, F.lit(pattern), 0), k)


def compact_evidence(values: Column) -> Column:
    """First three non-empty values joined with ``; ``."""
    return F.array_join(F.slice(F.filter(values, lambda v: F.length(v) > 0), 1, 3), "; ")


def glob_to_regex(pattern: str) -> str:
    """``*`` and ``?`` wildcards, anchored, case-insensitive; runs on the driver over parameters only."""
    wild = {"*": ".*", "?": "."}
    return "(?i)^" + "".join(wild.get(ch) or re.escape(ch) for ch in pattern) + "$"


def glob_match(c: Column, patterns) -> Column:
    """True when any pattern matches; no pattern matches nothing."""
    matched = F.lit(False)
    for pattern in patterns:
        matched = matched | c.rlike(glob_to_regex(pattern))
    return matched
