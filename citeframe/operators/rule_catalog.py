"""The built-in issue kinds and the registry for user-defined ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe import constants as C
from citeframe.functions import text as T


@dataclass(frozen=True)
class Rule:
    rule_no: int
    title: str
    severity: str
    scope: str
    category: str
    bucket: str
    message: str
    fix_hint: str

    @property
    def rule_id(self) -> str:
        return f"R{self.rule_no:02d}"


# fixed values: number, title, severity, scope, category and bucket of each issue kind.
# The message and the hint are free text.
_ROWS = [
    (1, "Missing robots.txt", "warn", "site", "crawlability", "access",
     "The site has no robots.txt.", "Publish a robots.txt that names the sitemap."),
    (2, "Missing sitemap discovery", "warn", "site", "crawlability", "access",
     "Neither a sitemap nor a fallback scan gave any url.", "Publish a sitemap or linked html entry pages."),
    (3, "Robots blocks all crawlers", "error", "site", "crawlability", "access",
     "robots.txt shuts every crawler out of the whole site.", "Open product and documentation pages to crawlers."),
    (4, "{bot} is blocked", "warn", "site", "crawlability", "access",
     "robots.txt shuts out {bot}.", "Let {bot} in if answers on that surface matter."),
    (5, "Page fetch failed", "error", "page", "crawlability", "access",
     "The page could not be read.", "Serve the page without needing a browser session."),
    (6, "Key page is noindex", "error", "page", "indexability", "access",
     "A key page asks not to be indexed.", "Drop noindex where pages should be found and cited."),
    (7, "Missing page title", "error", "page", "structure", "structure",
     "A key page has no title.", "Give the page a descriptive title."),
    (8, "Short page title", "warn", "page", "structure", "structure",
     "A key page has a very short title.", "Say what the page and the product are for."),
    (9, "Missing meta description", "warn", "page", "structure", "structure",
     "A key page has no meta description.", "Summarise whom the page serves and what it shows."),
    (10, "Missing H1", "error", "page", "structure", "structure",
     "A key page has no main heading.", "Add one clear H1."),
    (11, "Multiple H1 headings", "warn", "page", "structure", "structure",
     "A key page has several main headings.", "Keep a single H1."),
    (12, "Thin key page", "warn", "page", "structure", "structure",
     "A key page holds little text.", "Add explanations, proof and fuller sections."),
    (13, "Weak heading structure", "warn", "page", "structure", "structure",
     "A key page has fewer than two H2 or H3 sections.", "Divide the page into headed sections."),
    (14, "JavaScript-heavy thin page", "warn", "page", "structure", "structure",
     "A key page is mostly script with little text.", "Render the main content on the server."),
    (15, "Low ARIA coverage on controls", "info", "page", "accessibility", "structure",
     "Most controls of the page carry no aria-label.", "Label the important controls."),
    (16, "Structured data name is not visible", "warn", "page", "schema", "structure",
     "A JSON-LD name does not show in the page text.", "Repeat the name in headings or copy."),
    (17, "Structured data description is not visible", "info", "page", "schema", "structure",
     "A JSON-LD description does not show in the page text.", "Bring description and copy in line."),
    (18, "FAQ schema does not match visible questions", "warn", "page", "schema", "structure",
     "A JSON-LD question does not show in the page text.", "Show the same questions on the page."),
    (19, "FAQ schema answers are not visible", "info", "page", "schema", "structure",
     "A JSON-LD answer does not show in the page text.", "Show the same answers on the page."),
    (20, "Homepage lacks JSON-LD", "info", "page", "schema", "structure",
     "The homepage has no structured data.", "Add Organization or Product data that matches the text."),
    (21, "FAQ page lacks FAQ schema", "info", "page", "schema", "structure",
     "A FAQ page has no FAQPage data.", "Add FAQPage data for the shown questions."),
    (22, "FAQ schema is not reinforced by visible Q&A structure", "warn", "page", "schema", "structure",
     "FAQPage data exists but the page shows no question structure.", "Show questions as headings or lists."),
    (23, "Structured data is not reinforced by visible category text", "info", "page", "schema", "structure",
     "Product data exists but the text hardly names the category.", "Name the category in headings and copy."),
    (29, "FAQ page lacks scannable question structure", "info", "page", "coverage", "comparativeReadiness",
     "The FAQ page is not built around questions.", "Use question headings with short answers."),
    (30, "Compare page does not name declared competitors", "warn", "page", "comparison", "comparativeReadiness",
     "A compare page names no declared competitor.", "Name the main competitors and how they differ."),
    (31, "Compare page lacks decision-making structure", "info", "page", "comparison", "comparativeReadiness",
     "A compare page has fewer than two sections.", "Separate fit, trade-offs and decision criteria."),
    (32, "Use-case page lacks contextual structure", "info", "page", "coverage", "comparativeReadiness",
     "A use-case page has fewer than two sections.", "Separate problem, workflow and outcome."),
    (33, "Homepage was not crawled", "error", "site", "coverage", "access",
     "No homepage was read.", "Make sure the homepage is public and reachable."),
    (34, "Homepage category signal is weak", "warn", "page", "positioning", "entityClarity",
     "The homepage hardly names the product category.", "Name the category in the opening copy."),
    (35, "Homepage persona fit is implicit", "info", "page", "positioning", "entityClarity",
     "The homepage names none of the target personas.", "Name the main buyer or team."),
    (36, "Homepage use cases are underspecified", "info", "page", "positioning", "entityClarity",
     "The homepage names none of the key use cases.", "Describe the main use cases near the top."),
    (37, "Homepage under-links key proof pages", "warn", "page", "coverage", "comparativeReadiness",
     "The homepage links to fewer than three kinds of proof pages.", "Link pricing, docs, security, FAQ or compare."),
    (44, "Use-case coverage is thin", "info", "site", "coverage", "comparativeReadiness",
     "The site has fewer than three use-case pages.", "Add use-case pages for further audiences."),
    (45, "Compare pages do not mention declared competitors", "info", "site", "comparison", "comparativeReadiness",
     "No compare page names a declared competitor.", "Add pages against the main competitors."),
    (46, "Key proof page is weakly linked", "warn", "page", "coverage", "comparativeReadiness",
     "Too few other pages link here in a way that explains the page.", "Link it from related pages with clear anchors."),
    (47, "Anchor text is generic for proof page", "warn", "page", "coverage", "comparativeReadiness",
     "No incoming anchor says what the page is for.", "Use anchors that name the purpose of the page."),
    (48, "Proof page lacks contextual support", "warn", "page", "coverage", "comparativeReadiness",
     "No text around an incoming link explains the page.", "Add a phrase on why readers should follow the link."),
]
RULES = {row[0]: Rule(*row) for row in _ROWS}

for _type, (_no, _title, _severity, _needed, _groups) in C.EVIDENCE_GROUPS.items():
    RULES[_no] = Rule(_no, _title, _severity, "page", "evidence", "evidence",
                      "Too few kinds of evidence.", f"Add what is listed as missing to the {_type} page.")

for _i, (_type, _label, _severity, _bucket) in enumerate(C.REQUIRED_PAGE_TYPES):
    RULES[38 + _i] = Rule(38 + _i, f"Missing {_label}", _severity, "site", "coverage", _bucket,
                          f"The site has no {_type} page.", f"Add a {_type} page with content that can be cited.")

SITE_PHASE, PAGE_PHASE, FINAL_PHASE, LINK_PHASE = 1, 2, 3, 4


def found(rule_no: int, *, severity: Column | None = None, message: Column | None = None,
          evidence: Column | None = None, sub_ord: int = 0) -> Column:
    """What a rule itself contributes to an issue; everything fixed is looked up by number later."""
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(rule_no).alias("rule_no"),
        (none if severity is None else severity).alias("severity"),
        (none if message is None else message).alias("message"),
        (none if evidence is None else evidence).alias("evidence"),
        F.lit(sub_ord).alias("sub_ord"),
    )


def _lookup(rules: list[Rule]) -> Column:
    """Constant map from rule number to the fixed parts of its issues."""
    fields = ["severity", "scope", "category", "bucket", "title", "message", "fix_hint"]
    entries = []
    for rule in rules:
        parts = ", ".join(f"'{f}', {T.sql_string(getattr(rule, f))}" for f in fields)
        entries.append(f"{rule.rule_no}, named_struct({parts})")
    return F.expr(f"map({', '.join(entries)})")


def to_issues(df: DataFrame, issues: Column, phase: Column, *, url: Column, rank: Column, book: "RuleBook | None" = None) -> DataFrame:
    """Explode an array of findings into issue rows.

    ``url`` and ``rank`` are the page the row stands for. ``issue_seq`` sorts issues in the order
    they are raised: site rules, page rules page by page, closing site rules, link rules page by page.
    """
    rules = list(RULES.values()) + (book.rules if book is not None else [])
    df = df.select("site_id", url.alias("_url"), rank.alias("_rank"), F.explode(issues).alias("i"))
    df = df.withColumn("r", F.element_at(_lookup(rules), F.col("i.rule_no"))).withColumn("phase", phase)
    by_page = F.col("phase").isin(PAGE_PHASE, LINK_PHASE)
    bot = F.get(T.string_array(C.AI_BOTS), F.col("i.sub_ord"))
    named = {c: F.when(F.col("i.rule_no") == 4, F.replace(f"r.{c}", F.lit("{bot}"), bot)).otherwise(F.col(f"r.{c}")) for c in ("title", "message", "fix_hint")}
    df = df.withColumns({"title": named["title"], "page_url": F.when(F.col("r.scope") == "page", F.col("_url"))})
    tail = F.concat(F.lit("-"), T.slug(F.col("page_url")))
    return df.select(
        "site_id",
        F.concat(F.lit("R"), F.lpad(F.col("i.rule_no").cast("string"), F.when(F.col("i.rule_no") > 99, 3).otherwise(2), F.lit("0"))).alias("rule_id"),
        F.concat(T.slug(F.col("title")), F.coalesce(tail, F.lit(""))).alias("issue_id"),
        F.coalesce("i.severity", "r.severity").alias("severity"),
        "r.scope", "r.category", "r.bucket", "title",
        F.coalesce(F.col("i.message"), named["message"]).alias("message"),
        named["fix_hint"].alias("fix_hint"),
        "page_url", "i.evidence",
        F.struct(
            "phase",
            F.when(by_page, F.col("_rank")).otherwise(0).cast("int").alias("page_rank"),
            F.when(by_page, F.col("_url")).otherwise(F.lit("")).alias("page_key"),
            "i.rule_no", "i.sub_ord",
        ).alias("issue_seq"),
    )


LEVELS = {"site": SITE_PHASE, "page": PAGE_PHASE, "final": FINAL_PHASE}


class RuleBook:
    """User-defined rules: a condition column per rule, folded into the same projection as the built-in ones.

    ``site`` and ``final`` rules see the site facts row, ``page`` rules see the page features row.
    """

    def __init__(self) -> None:
        self._rules: list[tuple[str, Rule, Column]] = []

    def register_rule(self, level: str, rule_no: int, condition: Column, *, title: str, severity: str,
                      category: str, bucket: str, message: str, fix_hint: str) -> "RuleBook":
        if level not in LEVELS:
            raise ValueError(f"level must be one of {sorted(LEVELS)}")
        if severity not in C.SEVERITY_PENALTY or bucket not in C.BUCKETS:
            raise ValueError("unknown severity or bucket")
        if rule_no in RULES or any(rule_no == r.rule_no for _, r, _ in self._rules):
            raise ValueError(f"rule number {rule_no} is taken")
        scope = "page" if level == "page" else "site"
        self._rules.append((level, Rule(rule_no, title, severity, scope, category, bucket, message, fix_hint), condition))
        return self

    @property
    def rules(self) -> list[Rule]:
        return [rule for _, rule, _ in self._rules]

    def numbers(self, level: str) -> list[int]:
        return [rule.rule_no for at, rule, _ in self._rules if at == level]

    def findings(self, level: str) -> list[Column]:
        return [F.when(condition, found(rule.rule_no)) for at, rule, condition in self._rules if at == level]


def raised(findings: list[Column]) -> Column:
    """The findings whose condition holds, as an array."""
    return F.filter(F.array(*findings), lambda i: i.isNotNull())
