"""Page features: type, flags, schema signals and evidence signals (native columns over P1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe import constants as C
from citeframe.functions import text as T
from citeframe.functions import urls as U
from citeframe.session import stage


def _path(url: Column) -> Column:
    """Lower-case path without trailing slashes."""
    bare = F.regexp_replace(F.lower(U.url_path(url)), "/+$", "")
    return T.let(bare, lambda p: F.when(F.length(p) > 0, p).otherwise(F.lit("/")))


def with_site(pages: DataFrame, sites: DataFrame | None) -> DataFrame:
    """Adds ``base_url`` of the site, NULL without ``sites``; every later step reads it from the row.

    The two columns of the sites are written first, so that the optimizer knows their size: while they are small, the
    wide rows stay in the tasks that scanned them.
    """
    if "base_url" in pages.columns:
        return pages
    if sites is None:
        return pages.withColumn("base_url", F.lit(None).cast("string"))
    return pages.join(stage(sites.select("site_id", "base_url"), "site-urls"), "site_id", "left")


def classify_page_type(pages: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Adds ``page_type``: home paths first, then the ordered word rules, else ``other``.

    ``sites`` supplies base paths; without it every base path is ``/``.
    """
    df = with_site(pages, sites)
    df = df.withColumn("_base", F.coalesce(_path(F.col("base_url")), F.lit("/")))
    df = df.withColumn("_path", _path(F.col("url")))
    df = df.withColumn("_hay", F.lower(F.concat_ws(" ", "title", "h1", "_path")))
    path, hay, base = F.col("_path"), F.col("_hay"), F.col("_base")
    prefix = F.when(base == "/", F.lit("")).otherwise(base)
    home = (path == "/") | (path == base)
    for locale in C.HOME_LOCALES:
        home = home | (path == F.concat(prefix, F.lit("/" + locale)))
    kind = F.when(home, F.lit("home"))
    for page_type, in_path, in_text in C.PAGE_TYPE_WORDS:
        kind = kind.when(U.path_has_any(path, in_path) | U.path_has_any(hay, in_text), F.lit(page_type))
    return df.withColumn("page_type", kind.otherwise(F.lit("other"))).drop("_base", "_path", "_hay")


def crawl_rank(url: Column) -> Column:
    """Crawl priority of a url from its path alone."""
    path = F.lower(U.url_path(url))
    words = {t: w for t, w, _ in C.PAGE_TYPE_WORDS}
    rank = F.when(path == "/", F.lit(C.CRAWL_RANK_HOME))
    for i, page_type in enumerate(C.CRAWL_ORDER_TYPES, start=1):
        rank = rank.when(U.path_has_any(path, words[page_type]), F.lit(i))
    return rank.otherwise(F.lit(C.CRAWL_RANK_REST)).cast("int")


# fixed values: text patterns of the flags and evidence signals. The leading look-aheads only let the
# regex engine skip positions that cannot match.
_MONTH = "20\\d{2}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_DATE_AT = f"(?i)(?=[2jfmasond]){T.WORD_START}"
DATE_FLAG = f"{_DATE_AT}({_MONTH}){T.WORD_END}"
DATE_WORDS = f"{_DATE_AT}(?:{_MONTH})[a-z]*{T.WORD_END}"
VERSION = f"(?i)(?=[v\\d]){T.WORD_START}v?\\d+\\.\\d+(?:\\.\\d+)?{T.WORD_END}"
TRUST_FLAG = f"(?=[sigeahd]){T.WORD_START}(soc ?2|iso ?27001|sso|saml|gdpr|encryption|audit log|hipaa|dpa){T.WORD_END}"
NUMBER_FLAG = f"(?=\\d){T.WORD_START}\\d{{1,3}}(?:[.,]\\d+)?%?{T.EDGE}"
NUMBER_WORDS = (
    f"(?i)(?=[$\\d])(?:\\${T.SPACE}?\\d{{1,4}}(?:[.,]\\d+)?"
    f"|{T.WORD_START}\\d{{1,4}}(?:[.,]\\d+)?%?(?:{T.SPACE}?(?:k|m|b|days?|weeks?|months?|users?|seats?))?{T.EDGE})"
)


def derive_page_flags(pages: DataFrame) -> DataFrame:
    """Adds counts and flags of the body text, the 240 character snippet and ``page_text``.

    ``page_text`` joins title, description, h1, headings and snippet; it is what most rules read.
    Script counts come from the raw html, so script-heavy pages are really found.
    """
    text = F.col("body_text")
    lower = F.lower(text)
    df = pages.withColumns(
        {
            "word_count": T.word_count(text),
            "noindex": F.contains("robots_meta", F.lit("noindex")),
            "has_date": text.rlike(DATE_FLAG),
            "has_version": text.rlike(VERSION),
            "has_trust": lower.rlike(TRUST_FLAG),
            "has_numbers": text.rlike(NUMBER_FLAG),
            "text_snippet": F.substring(text, 1, 240),
            "is_key": F.col("page_type").isin(C.KEY_PAGE_TYPES),
            "is_ok": F.col("fetch_error").isNull() & (F.coalesce("status", F.lit(0)) != 0),
            "page_rank": F.coalesce(F.col("crawl_rank"), crawl_rank(F.col("url")))
            if "crawl_rank" in pages.columns
            else crawl_rank(F.col("url")),
        }
    )
    joined = [F.col(c) for c in ("title", "meta_description", "h1")]
    joined += [F.array_join("headings", " "), F.col("text_snippet")]
    return df.withColumns(
        {
            "js_heavy": (F.col("word_count") < 120) & (F.col("scripts") >= 5),
            "page_text": F.trim(F.concat_ws(" ", *joined)),
        }
    )


def evidence_column(text: str = "body_text") -> Column:
    """Evidence signals of a page as an array of (signal, n, examples); absent signals are left out."""
    body, lower = F.col(text), F.col("_lower")

    def found(kind: str, examples: Column) -> Column:
        return T.let(
            examples,
            lambda x: F.struct(F.lit(kind).alias("signal"), F.size(x).alias("n"), F.slice(x, 1, 3).alias("examples")),
        )

    def counted(kind: str, n: Column, unit: str) -> Column:
        plural = F.when(n == 1, F.lit("")).otherwise(F.lit("s"))
        label = F.concat(n.cast("string"), F.lit(f" {unit}"), plural)
        return F.struct(F.lit(kind).alias("signal"), n.alias("n"), F.array(label).alias("examples"))

    depth = F.when(
        F.col("page_type").isin(C.BODY_DEPTH_PAGE_TYPES), F.floor(F.col("word_count") / 80).cast("int")
    ).otherwise(F.lit(0))
    words = F.concat(F.col("word_count").cast("string"), F.lit(" words"))
    signals = F.array(
        found("numbers", T.regex_examples(body, NUMBER_WORDS)),
        counted("tables", F.col("tables"), "table"),
        counted("lists", F.col("lists"), "list"),
        found("trust-markers", T.term_hits(lower, C.TRUST_TERMS)),
        found("freshness", T.regex_examples(body, DATE_WORDS)),
        found("versions", T.regex_examples(body, VERSION)),
        found("pricing-proof", T.term_hits(lower, C.PRICING_TERMS)),
        found("comparison-criteria", T.term_hits(lower, C.COMPARISON_TERMS)),
        found("workflow-proof", T.term_hits(lower, C.WORKFLOW_TERMS)),
        found("outcome-proof", T.term_hits(lower, C.OUTCOME_TERMS)),
        found("docs-proof", T.term_hits(lower, C.DOCS_TERMS)),
        F.struct(F.lit("body-depth").alias("signal"), depth.alias("n"), F.array(words).alias("examples")),
    )
    return F.filter(signals, lambda s: s["n"] > 0)


def with_evidence(pages: DataFrame) -> DataFrame:
    """Adds ``evidence_signals``."""
    return pages.withColumn("_lower", F.lower("body_text")).withColumn("evidence_signals", evidence_column()).drop("_lower")


def evidence_signals(pages: DataFrame) -> DataFrame:
    """Long evidence table (site_id, url, signal, n, examples)."""
    source = pages if "evidence_signals" in pages.columns else with_evidence(pages)
    return source.select("site_id", "url", F.explode("evidence_signals").alias("s")).select("site_id", "url", "s.*")


def features_of(parts: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """P2 to P7 over extracted parts, in one narrow plan; the only shuffle is the optional join with ``sites``."""
    from citeframe.operators.jsonld import with_jsonld, with_schema_signals
    from citeframe.operators.links import with_links

    df = with_site(parts, sites)
    df = derive_page_flags(classify_page_type(df, sites))
    df = with_evidence(with_schema_signals(with_jsonld(df)))
    return with_links(df).drop("base_url")


def page_features(pages_raw: DataFrame, sites: DataFrame | None = None, keep_site_text: bool = False) -> DataFrame:
    """Parts, type, flags, JSON-LD records, schema signals, evidence, links."""
    from citeframe.operators.extract import extract_pages, spread

    return features_of(extract_pages(spread(pages_raw), keep_site_text), sites)
