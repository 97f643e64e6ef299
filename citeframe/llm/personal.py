"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, a plus before a digit, digits around a dot, digit
pairs, schemes and the cue IBAN. A deterministic parser for each anchor expands it to the left and right and
validates what it found: mail addresses, internet addresses (parts at most 255), card numbers (14 to 19 digits,
Luhn), telephone numbers (10 to 15 digits). Matches of a kind are leftmost and do not overlap; one that fails is
dropped without another try inside it. Beyond these base kinds the method adds ``login`` (user and host part of a
web address) and ``account`` (IBAN after its cue, as long as its country has it, checked modulo 97).

Rows are scanned in place, whole, in Arrow batches; nothing is shuffled. Offsets are code points.

Defined cases: null texts count as empty and have no spans. Repeated rows, null ids and ties need nothing special;
an empty table gives an empty result. Extra columns are left out by name.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://([^\s/?#@:]+(?::[^\s/?#@]*)?@[A-Za-z0-9.-]+)")
_IBAN = re.compile(
    r"(?i:iban)[\x20:#=.-]{0,3}(?:(?i:account|number|num|code|is|no|nr)\b[\x20:#=.-]{0,3}){0,2}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})"
)
# characters of an account by country, as registered
LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW YE",
        31: "MT MU SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


@lru_cache(maxsize=1)
def _automaton():
    anchors = ahocorasick.Automaton()
    anchors.add_word("@", "at")
    anchors.add_word("://", "scheme")
    for cue in ("IBAN", "Iban", "iban"):
        anchors.add_word(cue, "cue")
    for d in "0123456789":
        anchors.add_word("+" + d, "plus")
        for e in "0123456789":
            anchors.add_word(f"{d}.{e}", "dot")
            for gap in ("", " ", "-"):
                anchors.add_word(d + gap + e, "pair")
    anchors.make_automaton()
    return anchors


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban(text: str, start: int, stop: int) -> int:
    """End of the account from ``start``, as long as its country has it (else up to ``stop``); 0 if it fails."""
    length, end = LENGTHS.get(text[start : start + 2]), stop
    if length:
        end, left = start, length
        while left and end < stop:
            left -= text[end] != " "
            end += 1
        if left or end < stop and text[end] != " ":
            return 0
    code = text[start:end].replace(" ", "")
    return end if 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else 0


def _part(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, in order."""
    if not text:
        return []
    out, done = [], [0] * len(KINDS)
    dotted_end = spaced_end = 0
    for end, anchor in _automaton().iter(text):
        if anchor == "at":
            left = end
            while left > done[0] and text[left - 1] in _LOCAL:
                left -= 1
            domain = _DOMAIN.match(text, end + 1) if left < end else None
            if domain:
                out.append((left, 0, domain.end()))
                done[0] = domain.end()
        elif anchor == "dot":
            left = end - 2
            if left < dotted_end:
                continue
            while left > dotted_end and text[left - 1] in _DIGITS:
                left -= 1
            chain = _DOTTED.match(text, left)
            dotted_end, parts, at = chain.end(), chain[0].split("."), left
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                stop = at + sum(map(len, four)) + 3
                if all(map(_part, four)):
                    out.append((at, 1, stop))
                at = stop + 1
        elif anchor == "pair":
            left = end - 1 if text[end - 1] in _DIGITS else end - 2
            if left < spaced_end:
                continue
            run = _SPACED.match(text, left)
            spaced_end = run.end()
            digits = run[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((left, 2, spaced_end))
        elif anchor == "plus":
            number = _PHONE.match(text, end - 1)
            if number and 10 <= sum(c in _DIGITS for c in number[0]) <= 15:
                out.append((end - 1, 3, number.end()))
        elif anchor == "scheme":
            login = _LOGIN.match(text, end - 2)
            if login and login.start(1) >= done[4]:
                out.append((login.start(1), 4, login.end(1)))
                done[4] = login.end(1)
        else:
            account = _IBAN.match(text, end - 3)
            if account and account.start(1) >= done[5] and (stop := _iban(text, account.start(1), account.end(1))):
                out.append((account.start(1), 5, stop))
                done[5] = stop
    return sorted(out)


@F.arrow_udf(SPANS)
def _found(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in find(t.as_py())] for t in texts], kind)


def scan(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, spans) of each row; spans are sorted by start, then kind."""
    return docs.select(docs[id_col].alias("id"), _found(docs[text_col]).alias("spans"))


def listed(spans) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def number(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
