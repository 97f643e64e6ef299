"""Fixed values the operators need.

Everything in this module is a fixed value: results are only comparable with earlier runs when
these words, numbers, titles and labels stay exactly as they are.
"""

# --- fixed values: page types and buckets -------------------------------------------------

KEY_PAGE_TYPES = ["home", "product", "pricing", "security", "faq", "compare", "docs", "integrations", "use-case"]

KEY_PROOF_PAGE_TYPES = ["pricing", "security", "docs", "faq", "compare", "integrations", "use-case"]

BODY_DEPTH_PAGE_TYPES = ["pricing", "security", "docs", "compare", "use-case"]

BUCKETS = ["access", "structure", "entityClarity", "evidence", "comparativeReadiness"]

# (page type, label, severity, bucket), in the order the issues are raised
REQUIRED_PAGE_TYPES = [
    ("pricing", "Pricing page", "error", "evidence"),
    ("security", "Security page", "warn", "evidence"),
    ("docs", "Documentation page", "warn", "evidence"),
    ("faq", "FAQ page", "warn", "comparativeReadiness"),
    ("compare", "Compare page", "warn", "comparativeReadiness"),
    ("integrations", "Integrations page", "warn", "comparativeReadiness"),
]

AI_BOTS = ["OAI-SearchBot", "PerplexityBot"]

# --- fixed values: severities and weights -------------------------------------------------

SEVERITY_PENALTY = {"error": 18, "warn": 8, "info": 3}
SEVERITY_RANK = {"error": 3, "warn": 2, "info": 1}
PRIORITY_WEIGHT = {"high": 1.5, "medium": 1.0, "low": 0.75}

NO_EVIDENCE_SEVERITY = {
    "pricing": "warn",
    "security": "warn",
    "docs": "warn",
    "faq": "info",
    "compare": "info",
    "integrations": "info",
    "use-case": "info",
}

WEAK_LINK_WARN_TYPES = ["pricing", "security", "docs", "faq", "compare"]
TWO_SOURCE_TYPES = ["faq", "compare", "integrations", "use-case"]

# --- fixed values: page classification and crawl order ------------------------------------
# (page type, words looked for in the path, words looked for in title + h1 + path)

PAGE_TYPE_WORDS = [
    ("pricing", ["pricing", "plans"], ["pricing"]),
    ("security", ["security", "trust"], ["security"]),
    ("faq", ["faq"], []),
    ("compare", ["compare", "alternatives", "/vs"], ["alternative"]),
    ("docs", ["docs", "developers", "api"], ["documentation"]),
    ("integrations", ["integrations"], []),
    ("use-case", ["use-case", "solutions", "for-"], []),
    ("product", ["product", "platform", "features"], ["product"]),
]

HOME_LOCALES = ["en", "zh", "zh-cn"]

# page types whose path words set the crawl order, best first; every other path comes last
CRAWL_ORDER_TYPES = ["pricing", "security", "faq", "compare", "docs", "integrations", "use-case"]
CRAWL_RANK_HOME = 0
CRAWL_RANK_REST = 9

# --- fixed values: evidence vocabulary ----------------------------------------------------

TRUST_TERMS = [
    "soc 2", "iso 27001", "sso", "saml", "gdpr", "encryption", "audit log", "dpa", "hipaa", "role-based",
    "安全", "信任", "密钥", "权限", "审阅", "加密", "合规",
]
PRICING_TERMS = [
    "plan", "pricing", "price", "starter", "growth", "enterprise", "seat", "quote", "free", "$",
    "定价", "价格", "成本", "开源", "免费", "打包",
]
COMPARISON_TERMS = [
    "compare", "alternative", "versus", "vs", "criteria", "trade-off", "decision",
    "对比", "替代", "差异", "取舍", "决策", "看板",
]
WORKFLOW_TERMS = [
    "setup", "quickstart", "implementation", "workflow", "deploy", "configure", "onboard", "rollout",
    "设置", "上手", "工作流", "部署", "配置", "接入", "运行", "审阅",
]
OUTCOME_TERMS = [
    "reduce", "increase", "improve", "adoption", "activation", "time-to-value", "faster", "outcome",
    "减少", "增加", "改进", "改善", "更快", "结果", "目标", "采用",
]
DOCS_TERMS = [
    "api", "sdk", "quickstart", "reference", "guide", "version", "updated", "implementation",
    "文档", "指南", "示例", "版本", "更新", "实现", "说明",
]

# page type -> (rule number, title, severity, groups needed, [(group label, signal kinds)])
EVIDENCE_GROUPS = {
    "pricing": (24, "Pricing page evidence density is low", "warn", 3, [
        ("numeric prices or ranges", ["numbers"]),
        ("plan or packaging terms", ["pricing-proof"]),
        ("tables or scannable lists", ["tables", "lists"]),
        ("supporting body depth", ["body-depth"]),
    ]),
    "security": (25, "Security page evidence density is low", "warn", 2, [
        ("trust markers", ["trust-markers"]),
        ("controls lists or tables", ["lists", "tables"]),
        ("implementation or workflow detail", ["workflow-proof", "body-depth"]),
    ]),
    "docs": (26, "Docs page evidence density is low", "info", 2, [
        ("freshness or version markers", ["freshness", "versions"]),
        ("API, SDK, or guide terms", ["docs-proof"]),
        ("workflow or setup detail", ["workflow-proof", "lists", "tables"]),
    ]),
    "compare": (27, "Compare page evidence density is low", "info", 2, [
        ("comparison criteria", ["comparison-criteria"]),
        ("tables or scannable lists", ["tables", "lists"]),
        ("pricing, docs, or proof context", ["pricing-proof", "docs-proof", "trust-markers"]),
    ]),
    "use-case": (28, "Use-case page evidence density is low", "info", 2, [
        ("workflow or rollout detail", ["workflow-proof"]),
        ("outcomes or success criteria", ["outcome-proof", "numbers"]),
        ("supporting proof context", ["pricing-proof", "docs-proof", "trust-markers", "body-depth"]),
    ]),
}

# --- fixed values: JSON-LD ----------------------------------------------------------------

JSONLD_RECORD_TYPES = ["FAQPage", "Organization", "SoftwareApplication", "Product"]
PRODUCT_LIKE_TYPES = ["product", "softwareapplication", "service"]
FORBIDDEN_CLAIM_FIELDS = [
    "aggregateRating", "review", "reviewRating", "ratingValue", "downloadCount", "interactionStatistic",
]
PAGE_URL_TYPES = ["WebPage", "CollectionPage", "Dataset", "FAQPage"]

# --- fixed values: head tags checked across a site ----------------------------------------

OPEN_GRAPH_TAGS = ["og:title", "og:description", "og:url", "og:image", "og:image:alt"]
TWITTER_TAGS = ["twitter:card", "twitter:title", "twitter:description", "twitter:image", "twitter:image:alt"]
ABSOLUTE_URL_TAGS = ["og:url", "og:image", "twitter:image"]
ASSET_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "webp", "svg", "css", "js", "xml", "txt"]
LANGUAGES = ["en", "zh-CN", "x-default"]

# --- fixed values: anchors ----------------------------------------------------------------

GENERIC_ANCHORS = ["learn more", "read more", "more", "details", "click here", "here"]

PROOF_KEYWORDS = {
    "pricing": ["pricing", "plan", "cost", "quote", "定价", "价格", "费用", "成本", "报价", "方案"],
    "security": ["security", "compliance", "trust", "sso", "audit", "安全", "合规", "信任", "审计", "密钥"],
    "docs": ["docs", "documentation", "api", "guide", "quickstart", "文档", "指南", "快速开始", "说明", "配置"],
    "faq": ["faq", "question", "answer", "support", "问题", "问答", "回答", "支持"],
    "compare": ["compare", "alternative", "versus", "vs", "evaluate", "对比", "比较", "替代", "差异", "评估"],
    "integrations": [
        "integration", "integrations", "connect", "slack", "segment", "warehouse", "api",
        "集成", "接入", "连接", "工作流",
    ],
    "use-case": [
        "workflow", "team", "teams", "use", "case", "solution", "rollout", "onboarding",
        "使用场景", "场景", "团队", "产品营销", "开发者关系", "开源维护者", "接入",
    ],
}

# --- fixed values: answers ----------------------------------------------------------------

RECOMMENDATION_PHRASES = [
    "recommend", "recommended", "best", "better fit", "good fit", "strong choice", "top choice",
    "worth considering", "shortlist",
]

# (score column, label), in reporting order
STABILITY_SIGNALS = [
    ("mention", "mention"),
    ("accurate_mention", "accurate mention"),
    ("owned_citation", "owned citation"),
    ("trusted_citation", "trusted citation"),
    ("recommendation", "recommendation"),
    ("misrepresented", "misrepresentation"),
    ("competitor_excluded", "competitor exclusion"),
    ("vavr", "VAVR"),
]

# (summary column, label), in reporting order
DIFF_METRICS = [
    ("vavr", "VAVR"),
    ("mention_rate", "Mention rate"),
    ("accurate_mention_rate", "Accurate mention rate"),
    ("owned_citation_rate", "Owned citation rate"),
    ("trusted_citation_rate", "Trusted citation rate"),
    ("recommendation_rate", "Recommendation rate"),
    ("misrepresentation_rate", "Misrepresentation rate"),
    ("competitor_exclusion_gap", "Competitor exclusion gap"),
    ("fact_coverage_score", "Fact coverage score"),
    ("accuracy_rate", "Accuracy rate"),
]

# --- fixed values: search exports ---------------------------------------------------------

SEARCH_COLUMNS = ["page", "clicks", "impressions", "ctr", "position"]
SEARCH_SOURCE_LABEL = {"search-console": "Search Console", "bing-webmaster": "Bing Webmaster"}
