"""Policy and link scans over a document corpus.

A document is one row, so its lines, their neighbourhoods and its headings are arrays inside that
row: line scans need no window and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe.functions import text as T
from citeframe.operators.joins import lookup_join


@dataclass(frozen=True)
class Policy:
    """A line rule: any of ``patterns`` (Java regex) on the trimmed line, and ``also`` if given.

    ``needs`` lists lower-case words of which every match contains at least one. A plain substring
    search for them rules out nearly all documents and lines before any regex runs.
    """

    rule: str
    patterns: tuple[str, ...]
    negatable: bool = True
    also: str | None = None
    needs: tuple[str, ...] = ()

    def matches(self, line: Column, trimmed: Column, lower: Column) -> Column:
        text = trimmed if self.negatable else line
        found = text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in self.patterns))
        if self.also is not None:
            found = found & text.rlike(f"(?iu){self.also}")
        return self.possible(lower) & found

    def possible(self, lower: Column) -> Column:
        seen = F.lit(not self.needs)
        for word in self.needs:
            seen = seen | F.contains(lower, F.lit(word))
        return seen


# fixed values: patterns of the built-in policies and of phrases that lift them
_E = T.EDGE
POLICIES = [
    Policy("overclaim-ranking", (
        "(guarantee|promise|ensure|assure).{0,80}(rank|ranking|placement|traffic|visibility)",
        "(#1(?!\\d)|number one).{0,40}(rank|ranking)",
        f"(?=\\d){_E}\\d{{1,3}}%{_E}.{{0,60}}(lift|increase|improvement|traffic|ranking|visibility)",
        "排名.{0,20}(保证|承诺|提升)|提升.{0,20}\\d{1,3}%",
    ), needs=("guarantee", "promise", "ensure", "assure", "#1", "number one", "%", "排名", "提升")),
    Policy("consumer-ui-scraping", (
        "(consumer AI UI scraping|consumer UI scraping|scrape consumer AI|抓取消费级 AI|抓取消费级 UI)",
    ), needs=("consumer ", "抓取消费级")),
    Policy("fake-proof", (
        f"{_E}(aggregateRating|reviewRating|ratingValue|downloadCount){_E}",
        f"{_E}(testimonial|customer logo|customer proof|download count|star count){_E}",
        "客户案例|客户背书|下载量|星标数",
    ), needs=(
        "aggregaterating", "reviewrating", "ratingvalue", "downloadcount", "testimonial", "customer logo",
        "customer proof", "download count", "star count", "客户案例", "客户背书", "下载量", "星标数",
    )),
    Policy("robots-host-claim", (
        "(host-level|host-wide|whole host|controls the host|控制整个|控制 host)",
    ), also="robots\\.txt", needs=("robots.txt",)),
    Policy("local-absolute-path", ("(?:^|[\\s('\"=<])(?:file:///|/?[A-Za-z]:[\\\\/])",), negatable=False,
           needs=(":/", ":\\")),
]
NEGATION = (
    "\\?$"
    f"|{_E}does{_E}.{{0,80}}{_E}scrape{_E}"
    f"|{_E}(block or rewrite|what to block|claims or implies|must not imply){_E}"
    f"|{_E}(no|not|does not|do not|without|avoid|avoids|avoiding|block|reject|forbid|non-goal|non-goals|is not|must not"
    "|should not|cannot|can't|rather than|instead of|vs|versus|hard requirement|out of scope|should not change)"
    f"{_E}"
    "|不承诺|不会|不要|不能|禁止|不是|避免|非目标|无消费级|不抓取"
)


def package_install_policy(package: str) -> Policy:
    """Rule against advertising a package that is not published, for the given package name."""
    import re

    name = re.escape(package)
    return Policy("package-install-claim", (f"(npm (i|install|add)|npx|pnpm (add|dlx)|yarn (add|dlx)|bunx).{{0,80}}{name}",), needs=(package.lower(),))


def lines_of(text: Column) -> Column:
    return F.split(text, "\\r?\\n")


def _line_rows(docs: DataFrame, keep, before: int, after: int, glue: str) -> DataFrame:
    """The lines for which ``keep(entry)`` holds, each with the text of the lines around it.

    An entry has line, trimmed and lower. Lines are dropped before their surroundings are put
    together, so only hits carry context.
    """
    keys = [c for c in docs.columns if c != "text"]
    df = docs.withColumn("_lines", lines_of(F.col("text"))).drop("text")

    def around(i: Column) -> Column:
        first = F.greatest(i - before, F.lit(0))
        return F.array_join(F.slice(F.col("_lines"), first + 1, i + after - first + 1), glue)

    entries = F.transform(
        "_lines",
        lambda line, i: F.struct(
            i.alias("i"), line.alias("line"), T.trimmed(line).alias("trimmed"), F.lower(line).alias("lower")
        ),
    )
    hits = F.filter(entries, keep)
    spots = F.transform(
        hits, lambda x: F.struct((x["i"] + 1).alias("line_no"), x["line"].alias("line"), around(x["i"]).alias("context"))
    )
    return df.select(*keys, F.explode(spots).alias("s")).select(*keys, "s.*")


def scan_policies(docs: DataFrame, policies=tuple(POLICIES), negation: str = NEGATION, lookback: int = 5) -> DataFrame:
    """Lines that match a policy, unless the line or the lines just before it hold a negating phrase."""
    keys = [c for c in docs.columns if c != "text"]
    def any_broken(x: Column) -> Column:
        found = F.lit(False)
        for policy in policies:
            found = found | policy.matches(x["line"], x["trimmed"], x["lower"])
        return found

    def any_possible(lower: Column) -> Column:
        return reduce(lambda a, b: a | b, [p.possible(lower) for p in policies])

    candidates = docs.filter(T.let(F.lower("text"), any_possible))
    df = _line_rows(candidates, any_broken, lookback, 0, " ").withColumn("_line", T.trimmed(F.col("line")))
    df = df.withColumn("_low", F.lower("line"))
    hits = [
        F.when(
            p.matches(F.col("line"), F.col("_line"), F.col("_low")),
            F.struct(F.lit(p.rule).alias("rule"), F.lit(p.negatable).alias("negatable")),
        )
        for p in policies
    ]
    df = df.withColumn("_hits", F.filter(F.array(*hits), lambda h: h.isNotNull()))
    lifted = F.col("_line").rlike(f"(?iu){negation}") | F.col("context").rlike(f"(?iu){negation}")
    df = df.withColumn("_lifted", lifted).select(*keys, "line_no", "line", "_lifted", F.explode("_hits").alias("h"))
    return df.filter(~(F.col("h.negatable") & F.col("_lifted"))).select(*keys, "line_no", "h.rule", "line")


def scan_blocks(docs: DataFrame, trigger: str, mentions: str, excludes: str, n: int = 18) -> DataFrame:
    """Trigger lines whose block of ``n`` lines mentions A without the exclusion B."""
    df = _line_rows(docs, lambda x: x["line"].rlike(trigger), 0, n - 1, "\n")
    bad = F.col("context").rlike(mentions) & ~F.col("context").rlike(excludes)
    return df.filter(bad).drop("context")


def heading_slug(c: Column) -> Column:
    """Anchor of a heading: tags and code marks out, lower case, letters, digits, blanks and dashes only."""
    out = F.regexp_replace(T.trimmed(c), "<[^>]*>", "")
    out = F.regexp_replace(out, "`([^`]*)`", "$1")
    out = F.lower(F.replace(out, F.lit("&amp;"), F.lit("")))
    out = T.trimmed(F.regexp_replace(out, f"[^\\p{{L}}\\p{{N}}{T.SPACE[1:-1]}-]", ""))
    return F.regexp_replace(out, f"{T.SPACE}+", "-")


def heading_anchors(docs: DataFrame) -> DataFrame:
    """Anchors of a document's headings; repeats get a number in document order."""
    keys = [c for c in docs.columns if c != "text"]
    heads = F.filter(
        F.transform(
            F.split(F.col("text"), "\\r?\\n"),
            lambda line, i: F.struct(
                (i + 1).alias("line_no"), F.regexp_extract(line, "^#{1,6}\\s+(.+?)\\s*#*\\s*$", 1).alias("heading")
            ),
        ),
        lambda h: F.length(h["heading"]) > 0,
    )
    slugs = F.filter(
        F.transform(heads, lambda h: F.struct(heading_slug(h["heading"]).alias("slug"), h["line_no"].alias("line_no"))),
        lambda h: F.length(h["slug"]) > 0,
    )
    # sorted by (slug, line), entries of a slug are a run; each run counts from 0, so the whole walk is linear
    df = docs.withColumn("_sorted", F.array_sort(slugs)).withColumn("_slugs", F.transform("_sorted", lambda h: h["slug"]))
    begins = F.transform("_slugs", lambda s, i: F.when((i == 0) | (F.get("_slugs", i - 1) != s), i))
    df = df.withColumn("_begins", F.filter(begins, lambda i: i.isNotNull())).withColumn("_count", F.size("_slugs"))
    runs = F.transform("_begins", lambda at, k: F.sequence(F.lit(0), F.coalesce(F.get("_begins", k + 1), F.col("_count")) - at - 1))
    df = df.withColumn("_no", F.flatten(runs))
    numbered = F.transform(
        F.arrays_zip("_sorted", "_no"),
        lambda h: F.struct(h["_sorted"]["line_no"].alias("line_no"), h["_sorted"]["slug"].alias("slug"), h["_no"].alias("repeat_no")),
    )
    df = df.select(*keys, F.explode(numbered).alias("h")).select(*keys, "h.*")
    suffix = F.when(F.col("repeat_no") == 0, F.lit("")).otherwise(F.concat(F.lit("-"), F.col("repeat_no").cast("string")))
    return df.withColumn("anchor", F.concat("slug", suffix))


_LINK = "!?\\[[^\\]\\n]*\\]\\((<[^>\\n]+>|[^)\\s]+)(?:\\s+[\"'][^\"']*[\"'])?\\)"


def document_links(docs: DataFrame, path: str = "path") -> DataFrame:
    """Relative links of Markdown documents with target path and anchor; absolute urls are left out."""
    lines = F.transform(
        lines_of(F.col("text")), lambda line, i: F.struct((i + 1).alias("line_no"), F.regexp_extract_all(line, F.lit(_LINK), 1).alias("hrefs"))
    )
    df = docs.select(F.col(path).alias("path"), F.explode(F.filter(lines, lambda x: F.size(x["hrefs"]) > 0)).alias("x"))
    df = df.select("path", "x.line_no", F.explode("x.hrefs").alias("href"))
    df = df.withColumn("href", F.regexp_replace(F.trim("href"), "^<|>$", ""))
    df = df.filter((F.length("href") > 0) & ~F.col("href").rlike("(?i)^[a-z][a-z0-9+.-]*:"))
    # a plus sign is a plain character in a path
    decode = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    raw = F.regexp_replace(F.substring_index("href", "#", 1), "\\?.*$", "")
    hash_part = F.regexp_replace(F.when(F.contains("href", F.lit("#")), F.expr("split(href, '#')[1]")).otherwise(F.lit("")), "\\?.*$", "")
    df = df.withColumns({"_raw": raw, "_hash": hash_part}).filter((F.length("_raw") > 0) | (F.length("_hash") > 0))
    df = df.withColumns({"_target": decode(F.col("_raw")), "anchor": F.lower(decode(F.col("_hash")))})
    joined = F.when(F.startswith("_target", F.lit("/")), F.col("_target")).otherwise(
        F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("_target"))
    )

    def walk(p: Column) -> Column:
        """Folder steps resolved; a leading ``..`` stays and marks a target outside the root."""
        names = F.filter(F.split(p, "/"), lambda s: (s != ".") & (s != ""))
        stack = F.aggregate(
            names,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(
                (s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
            ).otherwise(F.array_append(acc, s)),
        )
        return F.array_join(stack, "/")

    target = F.when(F.length("_target") == 0, F.col("path")).otherwise(walk(joined))
    return df.select("path", "line_no", "href", target.alias("target"), "anchor", F.startswith("_target", F.lit("/")).alias("is_rooted"))


def doc_link_findings(docs: DataFrame, anchors: DataFrame | None = None, generated: str | None = None) -> DataFrame:
    """Links that cannot be decoded, leave the root, or point at no document or no heading of it.

    ``docs`` is (path, text). A folder counts as existing when any document lies below it.
    ``generated`` names a folder whose files need not exist.
    """
    links = document_links(docs)
    if anchors is None:
        anchors = heading_anchors(docs.select("path", "text"))
    if generated:
        inside = (F.col("target") == generated) | F.startswith("target", F.lit(generated + "/"))
        links = links.filter(~F.coalesce(inside, F.lit(False)))
    parts = F.split("path", "/")
    places = docs.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("target")
    ).distinct()
    heads = anchors.select(F.col("path").alias("target"), "anchor").distinct()
    # two left joins mark what exists, so the links themselves are read and parsed once
    df = lookup_join(links, places.withColumn("_place", F.lit(True)), ["target"], "left")
    df = lookup_join(df, heads.withColumn("_head", F.lit(True)), ["target", "anchor"], "left")
    outside = F.col("is_rooted") | F.col("target").rlike("^\\.\\.(/|$)")
    named = (F.length("anchor") > 0) & F.col("target").rlike("(?i)\\.md$")
    rule = (
        F.when(F.col("target").isNull() | F.col("anchor").isNull(), F.lit("undecodable"))
        .when(outside, F.lit("outside-root"))
        .when(F.length("target") == 0, F.lit(None).cast("string"))
        .when(F.col("_place").isNull(), F.lit("target-missing"))
        .when(named & F.col("_head").isNull(), F.lit("anchor-missing"))
    )
    return df.withColumn("rule", rule).filter("rule IS NOT NULL").select("path", "line_no", "href", "rule")
