"""Issue rules over page features, site facts and incoming links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeframe import constants as C
from citeframe.functions import text as T
from citeframe.operators.joins import lookup_join
from citeframe.operators.links import first_home, homepage_linked_types
from citeframe.operators.rule_catalog import (
    FINAL_PHASE, LINK_PHASE, PAGE_PHASE, RULES, SITE_PHASE, RuleBook, found, raised, to_issues,
)


def with_dims(df: DataFrame, brands: DataFrame | None, competitors: DataFrame | None) -> DataFrame:
    """Adds brand_category, personas, use_cases and competitor_names of the site.

    Brand and competitors become one row per site first, so pages take part in a single join. Its
    strategy is left to the optimizer's own size check; a hot site is split by the skew join.
    """
    dims = None
    if brands is not None:
        dims = brands.select("site_id", F.col("category").alias("brand_category"), "personas", "use_cases")
    if competitors is not None:
        names = competitors.groupBy("site_id").agg(
            F.array_sort(F.collect_list(F.struct("comp_ord", "name"))).alias("_c")
        )
        names = names.select("site_id", F.col("_c.name").alias("competitor_names"))
        dims = names if dims is None else dims.join(names, "site_id", "full")
    if dims is not None:
        df = df.join(dims, "site_id", "left")
    kinds = {"brand_category": "string", "personas": "array<string>", "use_cases": "array<string>", "competitor_names": "array<string>"}
    return df.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items() if n not in df.columns})


def _names_any(text: Column, names: Column) -> Column:
    return F.coalesce(F.exists(names, lambda n: F.contains(F.lower(text), F.lower(n))), F.lit(False))


# ---- page rules ------------------------------------------------------------------------


def _page_conditions() -> dict[int, Column]:
    """Condition of each page rule over the feature columns."""
    page_type, words = F.col("page_type"), F.col("word_count")
    key, sections = F.col("is_key"), F.size("headings")
    wordy = page_type.isin("home", "product", "pricing", "security", "docs")
    brief = page_type.isin("faq", "compare", "integrations", "use-case")
    unstructured = (F.col("lists") == 0) & (F.col("tables") == 0)
    kinds = F.transform("jsonld_types", F.lower)
    faq_schema = F.array_contains(kinds, "faqpage")
    product_schema = F.exists(kinds, lambda k: k.isin(C.PRODUCT_LIKE_TYPES))
    asked = F.size(F.filter("headings", lambda h: F.contains(h, F.lit("?"))))
    title_length = F.length("title")

    def hidden(field: str) -> Column:
        return F.exists("schema_signals", lambda s: (s["field"] == field) & ~s["visible"])

    category_cover = T.keyword_coverage(F.lower("page_text"), F.coalesce("brand_category", F.lit("")))
    return {
        6: key & F.col("noindex"),
        7: key & (title_length == 0),
        8: key & (title_length > 0) & (title_length < 20),
        9: key & (F.length("meta_description") == 0),
        10: key & (F.length("h1") == 0),
        11: key & (F.col("h1_count") > 1),
        12: (wordy & (words < 150)) | (brief & (words < 80) & unstructured),
        13: key & (sections < 2),
        14: key & F.col("js_heavy"),
        15: key & (F.col("controls") > 0) & (F.col("aria_controls") < 0.5 * F.col("controls")),
        16: hidden("name"),
        17: hidden("description"),
        18: hidden("faq.question"),
        19: hidden("faq.answer"),
        20: (page_type == "home") & (F.size("jsonld_types") == 0),
        21: (page_type == "faq") & ~faq_schema,
        22: faq_schema & (asked == 0) & (F.col("lists") == 0),
        23: page_type.isin("home", "product") & product_schema & (category_cover < 0.4),
        29: (page_type == "faq") & (asked < 2) & (F.col("lists") == 0),
        30: (page_type == "compare") & ~_names_any(F.col("page_text"), F.col("competitor_names")),
        31: (page_type == "compare") & (sections < 2),
        32: (page_type == "use-case") & (sections < 2),
    }


def _hidden_values(field: str, labelled: bool) -> Column:
    values = F.transform(
        F.filter("schema_signals", lambda s: (s["field"] == field) & ~s["visible"]),
        lambda s: F.concat(s["record_type"], F.lit("."), s["field"], F.lit(": "), s["value"]) if labelled else s["value"],
    )
    return T.compact_evidence(values)


def _evidence_density() -> Column:
    """The evidence rule of the page's type: how many of its signal groups are present.

    The groups of all types are one constant map, so a single expression serves every type.
    """
    rows = []
    for page_type, (rule_no, _, severity, needed, groups) in C.EVIDENCE_GROUPS.items():
        listed = ", ".join(
            f"named_struct('label', {T.sql_string(label)}, 'kinds', array({', '.join(T.sql_string(k) for k in kinds)}))"
            for label, kinds in groups
        )
        rows.append(
            f"{T.sql_string(page_type)}, named_struct('rule_no', {rule_no}, 'severity', '{severity}', 'needed', {needed}, 'groups', array({listed}))"
        )
    wanted = F.try_element_at(F.expr(f"map({', '.join(rows)})"), F.col("page_type"))
    signals = F.col("evidence_signals")

    def judged(group: Column) -> Column:
        mine = F.flatten(F.transform(group["kinds"], lambda k: F.filter(signals, lambda s: s["signal"] == k)))
        return F.struct(group["label"].alias("label"), mine.alias("mine"))

    def shown(g: Column) -> Column:
        examples = F.flatten(F.transform(g["mine"], lambda s: s["examples"]))
        more = F.when(F.size(examples) > 0, F.concat(F.lit(": "), T.compact_evidence(examples))).otherwise(F.lit(""))
        return F.concat(g["label"], more)

    def rule(w: Column, groups: Column) -> Column:
        present = F.filter(groups, lambda g: F.size(g["mine"]) > 0)
        absent = F.filter(groups, lambda g: F.size(g["mine"]) == 0)
        n, total = F.size(present), F.size(groups)
        have = F.when(n > 0, F.array_join(F.transform(present, shown), "; ")).otherwise(F.lit("none"))
        return F.when(
            n < w["needed"],
            F.struct(
                w["rule_no"].alias("rule_no"),
                F.when(n == 0, F.lit("warn")).otherwise(w["severity"]).alias("severity"),
                F.format_string("The %s page shows %d of %d kinds of evidence.", F.col("page_type"), n, total).alias("message"),
                F.concat(
                    F.lit("Missing: "), F.array_join(F.transform(absent, lambda g: g["label"]), ", "),
                    F.lit(". Present: "), have, F.lit("."),
                ).alias("evidence"),
                F.lit(0).alias("sub_ord"),
            ),
        )

    return T.let(wanted, lambda w: T.let(F.transform(w["groups"], judged), lambda groups: rule(w, groups)))


def page_issues(pages: DataFrame, book: RuleBook | None = None) -> DataFrame:
    """Issues of the page rules; ``pages`` carries features and the site's dimension columns.

    Every rule is a branch of one projection, so a page is read once and nothing is shuffled. A
    page that could not be fetched raises only that.
    """
    wordy = F.col("page_type").isin("home", "product", "pricing", "security", "docs")
    extra = {
        12: {"severity": F.when(wordy, "warn").otherwise("info")},
        16: {"evidence": _hidden_values("name", True)},
        17: {"evidence": _hidden_values("description", True)},
        18: {"evidence": _hidden_values("faq.question", False)},
        19: {"evidence": _hidden_values("faq.answer", False)},
    }
    rules = [F.when(condition, found(n, **extra.get(n, {}))) for n, condition in _page_conditions().items()]
    rules.append(_evidence_density())
    if book is not None:
        rules += book.findings("page")
    failed = found(5, message=F.coalesce("fetch_error", F.lit(RULES[5].message)))
    chosen = F.when(F.col("is_ok"), raised(rules)).otherwise(F.array(failed))
    return to_issues(pages, chosen, F.lit(PAGE_PHASE), url=F.col("url"), rank=F.col("page_rank"), book=book)


# ---- site rules ------------------------------------------------------------------------


def page_type_counts(pages: DataFrame) -> DataFrame:
    """Pages per type and site."""
    return pages.groupBy("site_id", "page_type").agg(F.count("*").alias("n_pages"))


def missing_page_types(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Required page types a site has no page of."""
    required = F.array(
        *[
            F.struct(F.lit(i).alias("type_ord"), F.lit(t).alias("page_type"), F.lit(label).alias("label"),
                     F.lit(severity).alias("severity"), F.lit(bucket).alias("bucket"))
            for i, (t, label, severity, bucket) in enumerate(C.REQUIRED_PAGE_TYPES)
        ]
    )
    wanted = sites.select("site_id", F.explode(required).alias("r")).select("site_id", "r.*")
    have = pages.select("site_id", "page_type").distinct()
    return wanted.join(have, ["site_id", "page_type"], "left_anti")


def site_facts(sites: DataFrame, pages: DataFrame, robots: DataFrame | None = None, discovered: DataFrame | None = None) -> DataFrame:
    """One row per site with everything the site rules look at.

    ``pages`` carries the dimension columns. All aggregates combine before the shuffle, so a site
    with most of the pages costs no more than any other.
    """
    per_type = [F.count_if(F.col("page_type") == t).alias(f"n_{t.replace('-', '_')}") for t in C.KEY_PAGE_TYPES]
    compare = F.col("page_type") == "compare"
    facts = pages.groupBy("site_id").agg(
        *per_type,
        F.count("*").alias("n_pages"),
        F.bool_or(compare & _names_any(F.col("page_text"), F.col("competitor_names"))).alias("compare_named"),
    )
    homes = first_home(pages)
    linked = homepage_linked_types(pages, homes)
    homes = homes.select("site_id", F.col("url").alias("home_url"), F.col("page_text").alias("home_text"))
    out = sites.select("site_id", "base_url").join(facts, "site_id", "left")
    out = out.join(homes, "site_id", "left").join(linked, "site_id", "left")
    if robots is not None:
        out = out.join(
            robots.select("site_id", F.col("exists").alias("robots_exists"), "blocked_all", "blocked_bots"), "site_id", "left"
        )
    else:
        out = out.withColumns({"robots_exists": F.lit(True), "blocked_all": F.lit(False), "blocked_bots": F.array().cast("array<string>")})
    if discovered is not None:
        found = discovered.groupBy("site_id").agg(F.count("*").alias("n_discovered"))
        out = out.join(found, "site_id", "left")
    else:
        out = out.withColumn("n_discovered", F.col("n_pages"))
    counts = [f"n_{t.replace('-', '_')}" for t in C.KEY_PAGE_TYPES] + ["n_pages", "n_discovered"]
    fill = {c: F.coalesce(c, F.lit(0)) for c in counts}
    fill |= {"robots_exists": F.coalesce("robots_exists", F.lit(False)), "blocked_all": F.coalesce("blocked_all", F.lit(False)),
             "blocked_bots": F.coalesce("blocked_bots", F.array().cast("array<string>")),
             "compare_named": F.coalesce("compare_named", F.lit(False)), "linked_types": F.coalesce("linked_types", F.lit(0))}
    return out.withColumns(fill)


def _covers(text_lower: Column, expected: Column) -> Column:
    return T.keyword_coverage(text_lower, expected) >= 0.5


def site_issues(facts: DataFrame, book: RuleBook | None = None) -> DataFrame:
    """Issues of the site rules; ``facts`` carries the dimension columns."""
    home, lower = F.col("home_url"), F.lower("home_text")
    has_home = home.isNotNull()
    no_names = F.size(F.coalesce("competitor_names", F.array().cast("array<string>"))) == 0

    def none_named(values: str) -> Column:
        given = F.coalesce(F.size(values), F.lit(0)) > 0
        return has_home & given & ~F.coalesce(F.exists(values, lambda v: _covers(lower, v)), F.lit(False))

    def at(no: int, condition: Column, **more) -> Column:
        return F.when(condition, found(no, **more))

    rules = [
        at(1, ~F.col("robots_exists")),
        at(2, F.col("n_discovered") == 0),
        at(3, F.col("blocked_all")),
        *[at(4, F.array_contains("blocked_bots", bot), sub_ord=i) for i, bot in enumerate(C.AI_BOTS)],
        at(33, ~has_home),
        at(34, has_home & ~_covers(lower, F.coalesce("brand_category", F.lit("")))),
        at(35, none_named("personas")),
        at(36, none_named("use_cases")),
        at(37, has_home & (F.col("linked_types") < 3)),
        *[at(38 + i, F.col(f"n_{t[0]}") == 0) for i, t in enumerate(C.REQUIRED_PAGE_TYPES)],
        at(44, F.col("n_use_case") < 3),
        at(45, (F.col("n_compare") > 0) & ~no_names & ~F.col("compare_named")),
    ]
    opening = [1, 2, 3, 4]
    if book is not None:
        rules += book.findings("site") + book.findings("final")
        opening += book.numbers("site")
    phase = F.when(F.col("i.rule_no").isin(opening), SITE_PHASE).otherwise(FINAL_PHASE)
    return to_issues(facts, raised(rules), phase, url=home, rank=F.lit(0), book=book)


# ---- link rules ------------------------------------------------------------------------


def _proof_keywords() -> Column:
    """Keywords of the target's page type; use-case pages add the words of their own title and h1."""
    own = F.array_distinct(T.keyword_tokens(F.concat_ws(" ", "dst_title", "dst_h1")))
    words = F.when(
        F.col("dst_page_type") == "use-case", F.array_union(own, T.string_array(C.PROOF_KEYWORDS["use-case"]))
    )
    for page_type, fixed in C.PROOF_KEYWORDS.items():
        if page_type != "use-case":
            words = words.when(F.col("dst_page_type") == page_type, T.string_array(fixed))
    return words


def judged_links(pages: DataFrame) -> DataFrame:
    """Incoming links of key proof pages with ``informative`` and ``supportive``.

    Informative: the anchor names the page type, or has two words, or eight characters, and is
    none of the stock phrases. Supportive: the text around the link names the page type.
    """
    proof = pages.filter(F.col("page_type").isin(C.KEY_PROOF_PAGE_TYPES)).select(
        "site_id", F.col("url").alias("dst_url"), F.col("title").alias("dst_title"), F.col("h1").alias("dst_h1"),
        F.col("page_type").alias("dst_page_type"),
    )
    links = pages.select(
        "site_id", F.col("url").alias("src_url"), F.col("page_rank").alias("src_rank"), F.explode("links").alias("l")
    )
    links = links.select("site_id", "src_url", "src_rank", "l.*").filter("is_internal AND dst_url <> src_url")
    df = lookup_join(links, proof.dropDuplicates(["site_id", "dst_url"]), ["site_id", "dst_url"])
    df = df.withColumns(
        {
            "_words": _proof_keywords(),
            "_anchor": T.squash(F.lower("anchor_text")),
            "_around": T.squash(F.lower("source_context")),
        }
    )
    anchor = F.col("_anchor")
    by_word = T.has_any(anchor, F.col("_words"))
    several = F.contains(anchor, F.lit(" "))
    stock = anchor.isin(C.GENERIC_ANCHORS)
    return df.withColumns(
        {
            "informative": (F.length(anchor) > 0) & (by_word | (~stock & (several | (F.length(anchor) >= 8)))),
            "supportive": T.has_any(F.col("_around"), F.col("_words")),
        }
    ).drop("_words", "_anchor", "_around", "dst_title", "dst_h1")


def link_evidence(links: DataFrame) -> DataFrame:
    """First three incoming links per target; the window limit drops the rest before the shuffle."""
    w = Window.partitionBy("site_id", "dst_url").orderBy("src_rank", "src_url", "link_ord")
    top = links.withColumn("_n", F.row_number().over(w)).filter("_n <= 3")
    return top.groupBy("site_id", "dst_url").agg(
        F.array_sort(F.collect_list(F.struct("_n", "anchor_text", "src_url", "source_context"))).alias("first_links")
    )


def link_facts(pages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Key proof pages with the counts the link rules look at."""
    links = judged_links(pages) if links is None else links
    per_source = links.groupBy("site_id", "dst_url", "src_url").agg(
        F.count("*").alias("n"),
        F.count_if("informative").alias("n_informative"),
        F.count_if("supportive").alias("n_supportive"),
        F.count_if(F.col("informative") | F.col("supportive")).alias("n_explained"),
    )
    counts = per_source.groupBy("site_id", "dst_url").agg(
        F.count("*").alias("n_sources"),
        F.sum("n").alias("n_links"),
        F.sum("n_informative").alias("n_informative"),
        F.sum("n_supportive").alias("n_supportive"),
        F.sum("n_explained").alias("n_explained"),
    )
    proof = pages.filter(F.col("page_type").isin(C.KEY_PROOF_PAGE_TYPES)).select(
        "site_id", F.col("url").alias("dst_url"), "page_type", "page_rank"
    )
    out = proof.join(counts, ["site_id", "dst_url"], "left").join(link_evidence(links), ["site_id", "dst_url"], "left")
    names = ["n_sources", "n_links", "n_informative", "n_supportive", "n_explained"]
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in names}).withColumnRenamed("dst_url", "url")


def link_issues(facts: DataFrame) -> DataFrame:
    """Issues of the link rules over ``link_facts``."""
    page_type = F.col("page_type")
    severity = F.when(page_type.isin(C.WEAK_LINK_WARN_TYPES), "warn").otherwise("info")
    needed = F.when(page_type.isin(C.TWO_SOURCE_TYPES), F.lit(2)).otherwise(F.lit(1))
    linked = F.col("n_links") > 0
    first = F.col("first_links")

    def shown(part) -> Column:
        return F.when(linked, T.compact_evidence(F.transform(first, part)))

    def at(no: int, condition: Column, **more) -> Column:
        return F.when(condition, found(no, severity=severity, **more))

    rules = [
        at(
            46,
            (F.col("n_sources") < needed) | (F.col("n_explained") == 0),
            message=F.concat(
                F.lit("The "), page_type, F.lit(" page is linked from "), F.col("n_sources").cast("string"), F.lit("/"),
                needed.cast("string"), F.lit(" other pages."),
            ),
            evidence=F.concat(
                F.lit("Incoming links: "), shown(lambda x: F.concat(x["anchor_text"], F.lit(" <- "), x["src_url"]))
            ),
        ),
        at(47, linked & (F.col("n_informative") == 0), evidence=shown(lambda x: x["anchor_text"])),
        at(48, linked & (F.col("n_supportive") == 0), evidence=shown(lambda x: x["source_context"])),
    ]
    return to_issues(facts, raised(rules), F.lit(LINK_PHASE), url=F.col("url"), rank=F.col("page_rank"))


def audit_issues(pages: DataFrame, sites: DataFrame, robots: DataFrame | None = None, brands: DataFrame | None = None,
                 competitors: DataFrame | None = None, discovered: DataFrame | None = None,
                 book: RuleBook | None = None) -> DataFrame:
    """All issues of all sites. ``pages`` should be a staged feature table: three branches read it."""
    known = with_dims(pages, brands, competitors)
    facts = with_dims(site_facts(sites, known, robots, discovered), brands, competitors)
    found = page_issues(known, book).unionByName(site_issues(facts, book))
    return found.unionByName(link_issues(link_facts(pages)))

