"""Answer evaluation over the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import derive as D
from catalog import sql_parts as P
from catalog.registry import joined, query, shared
from catalog.site_queries import _SCORES, _SUMMARY, _audit_summary
from citeframe import constants as C
from citeframe.operators import answers as A
from citeframe.operators import consensus as G


def _brands(spark, sf):
    return D.brands_of(spark, sf, D.ANSWER_BRANDS)


def _facts(spark, sf):
    return D.derived(spark, sf, D.ANSWER_FACTS)


def _competitors(spark, sf):
    return D.derived(spark, sf, D.ANSWER_COMPETITORS)


def _prompts(spark, sf):
    return D.derived(spark, sf, D.PROMPTS)


def _known(spark, sf):
    legal, _ = A.split_by_rank_rule(D.answers(spark, sf))
    return A.answers_with_prompts(legal, _prompts(spark, sf))[0]


def _scored(spark, sf):
    def build():
        dims = _brands(spark, sf), _facts(spark, sf), _competitors(spark, sf)
        return A.score_answers(A.score_citations(A.with_site_dims(_known(spark, sf), *dims), dims[0]), *dims)

    return shared(spark, sf, "answer-scores", build)


def _groups(spark, sf):
    return shared(spark, sf, "prompt-groups", lambda: G.prompt_groups(_scored(spark, sf)))


def _domain(u: str) -> str:
    bare = f"CASE WHEN {u} LIKE 'http%' THEN regexp_extract({u}, '://([^/]+)', 1) ELSE {u} END"
    return f"regexp_replace(lower({bare}), '^www\\.', '')"


_ID = "site_id, run_id, prompt_id, provider, sample_index"
_BASE = f"""WITH raw AS ({D.ANSWERS}), legal AS (
  SELECT * FROM raw WHERE rank_position IS NULL OR (mode = 'manual-import' AND rank_position >= 1)),
prompts AS ({D.PROMPTS}),
pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, prompt_id ORDER BY prompt_ord DESC) AS n FROM prompts) AS x WHERE n = 1),
known AS (
  SELECT l.* EXCLUDE (locale), coalesce(l.locale, pr.locale) AS locale, pr.category, pr.template AS prompt, pr.expected_signal, pr.intent,
    coalesce(pr.priority, 'medium') AS priority, coalesce(pr.holdout, FALSE) AS holdout
  FROM legal AS l JOIN pr ON pr.site_id = l.site_id AND pr.prompt_id = l.prompt_id),
brands AS ({D.ANSWER_BRANDS}), facts AS ({D.ANSWER_FACTS}), competitors AS ({D.ANSWER_COMPETITORS}),
cites AS (
  SELECT {_ID}, conv_id, turn, n - 1 AS cit_ord, url, {_domain('url')} AS domain,
    CASE WHEN conv_id % 11 = 5 AND first_cit THEN FALSE ELSE {_domain('url')} = b_domain OR ends_with({_domain('url')}, '.' || b_domain) END AS owned,
    {_domain('url')} IN ('docs.example.net', 'wiki.example.org') OR ends_with({_domain('url')}, '.docs.example.net') OR ends_with({_domain('url')}, '.wiki.example.org') AS trusted
  FROM (SELECT *, row_number() OVER (PARTITION BY {_ID} ORDER BY first_cit DESC) AS n FROM (
      SELECT k.*, cit1 AS url, TRUE AS first_cit, b.domain AS b_domain FROM known AS k JOIN brands AS b USING (site_id) WHERE cit1 IS NOT NULL
      UNION ALL SELECT k.*, cit2, FALSE, b.domain FROM known AS k JOIN brands AS b USING (site_id) WHERE cit2 IS NOT NULL) AS u) AS v),
cflags AS (SELECT {_ID}, bool_or(owned) AS own, bool_or(trusted) AS tru, list(domain ORDER BY cit_ord) AS domains FROM cites GROUP BY ALL),
fl AS (
  SELECT site_id, 0 AS ord, name || ' is a ' || category || '.' AS fact FROM brands UNION ALL SELECT site_id, 1, one_liner FROM brands
  UNION ALL SELECT site_id, fact_ord + 1, text FROM facts),
cov AS (
  SELECT k.site_id, k.run_id, k.prompt_id, k.provider, k.sample_index, fl.ord, fl.fact, {P.coverage('k.answer_text', 'fl.fact')} AS c
  FROM known AS k JOIN fl USING (site_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {_ID} ORDER BY c DESC, ord) AS rn FROM cov),
acc AS (
  SELECT {_ID}, avg(c) FILTER (rn <= 2) AS best, count(*) FILTER (c >= 0.5) / count(*) AS share, list(fact ORDER BY rn) FILTER (c >= 0.5) AS matched FROM ranked GROUP BY ALL),
comp AS (
  SELECT k.site_id, k.run_id, k.prompt_id, k.provider, k.sample_index, list(c.name ORDER BY c.comp_ord) AS names
  FROM known AS k JOIN competitors AS c ON c.site_id = k.site_id AND contains(lower(k.answer_text), lower(c.name)) GROUP BY ALL),
s0 AS (
  SELECT k.*, contains(lower(answer_text), lower(b.name))::INT AS mention, coalesce(f.own, FALSE)::INT AS owned_citation, coalesce(f.tru, FALSE)::INT AS trusted_citation,
    coalesce(f.domains, []) AS domains, coalesce(comp.names, []) AS competitor_mentions, a.best, a.share, a.matched
  FROM known AS k JOIN brands AS b USING (site_id) LEFT JOIN cflags AS f USING ({_ID}) LEFT JOIN acc AS a USING ({_ID}) LEFT JOIN comp USING ({_ID})),
s1 AS (
  SELECT *, CASE WHEN mention = 1 THEN best ELSE 0 END AS accuracy, CASE WHEN mention = 1 THEN share ELSE 0 END AS fact_coverage,
    CASE WHEN mention = 1 THEN coalesce(matched, []) ELSE [] END AS matched_facts,
    (mention = 1 AND best >= 0.5)::INT AS accurate_mention, (mention = 1 AND best < 0.35)::INT AS misrepresented,
    (mention = 1 AND len(list_filter({P.text_list(C.RECOMMENDATION_PHRASES)}, lambda w: contains(lower(answer_text), w))) > 0)::INT AS recommendation,
    (mention = 0 AND len(competitor_mentions) > 0)::INT AS competitor_excluded,
    CASE rank_position WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 WHEN 3 THEN 0.5 WHEN 4 THEN 0.25 WHEN 5 THEN 0.0 END::DOUBLE AS cps FROM s0),
s AS (
  SELECT *, (accurate_mention = 1 AND greatest(owned_citation, trusted_citation) = 1)::INT AS vavr,
    CASE expected_signal WHEN 'mention_or_recommend' THEN (accurate_mention + recommendation) / 2
      WHEN 'mention_position_accuracy' THEN (accurate_mention + accuracy) / 2
      WHEN 'citation_and_presence' THEN (accurate_mention + greatest(owned_citation, trusted_citation)) / 2
      WHEN 'brand_accuracy_balance' THEN (accurate_mention + fact_coverage + (1 - misrepresented)) / 3
      ELSE (accurate_mention + greatest(owned_citation, trusted_citation) + recommendation) / 3 END AS signal_alignment FROM s1)"""

_KEY = A.ANSWER_KEY


@query("j5_score_citations", _BASE + f" SELECT {_ID}, cit_ord, url, domain, owned, trusted FROM cites")
def j5(spark, sf):
    df = A.explode_citations(A.score_citations(_known(spark, sf), _brands(spark, sf)))
    return df.select(*_KEY, "cit_ord", "url", "domain", "owned", "trusted")


@query("j6_answers_with_prompts", _BASE + f" SELECT {_ID}, category, prompt, expected_signal, intent, priority, holdout, locale FROM known")
def j6(spark, sf):
    return _known(spark, sf).select(*_KEY, "category", "prompt", "expected_signal", "intent", "priority", "holdout", "locale")


@query("j6_unknown_prompts", _BASE + f" SELECT {_ID} FROM raw WHERE prompt_id = 'zz'")
def j6_unknown(spark, sf):
    return A.answers_with_prompts(D.answers(spark, sf), _prompts(spark, sf))[1].select(*_KEY)


@query("j7_competitor_mentions", f"""WITH raw AS ({D.ANSWERS}), competitors AS ({D.ANSWER_COMPETITORS})
  SELECT {_ID}, coalesce(array_to_string((SELECT list(c.name ORDER BY c.comp_ord) FROM competitors AS c WHERE c.site_id = raw.site_id AND contains(lower(raw.answer_text), lower(c.name))), '|'), '') AS competitor_mentions FROM raw""")
def j7(spark, sf):
    return A.competitor_mentions(D.answers(spark, sf), _competitors(spark, sf)).select(*_KEY, joined("competitor_mentions"))


@query("j8_sampling_plan", f"""SELECT site_id, prompt_id, prompt_ord, coalesce(locale, 'en') AS locale, coalesce(holdout, FALSE) AS holdout, 3 AS run_count,
    CAST(unnest(range(3)) AS INTEGER) AS sample_index FROM ({D.PROMPTS}) AS p""")
def j8(spark, sf):
    return A.sampling_plan(_prompts(spark, sf), 3, "en")


@query("e1_answer_signals", _BASE + f" SELECT {_ID}, mention, owned_citation, trusted_citation, recommendation, competitor_excluded, vavr FROM s")
def e1(spark, sf):
    return _scored(spark, sf).select(*_KEY, "mention", "owned_citation", "trusted_citation", "recommendation", "competitor_excluded", "vavr")


@query("e2_fact_accuracy", _BASE + f""" SELECT {_ID}, round(accuracy, 6) AS accuracy, round(fact_coverage, 6) AS fact_coverage,
    array_to_string(matched_facts, '|') AS matched_facts, accurate_mention, misrepresented FROM s""")
def e2(spark, sf):
    df = A.fact_accuracy(_known(spark, sf), _brands(spark, sf), _facts(spark, sf))
    return df.select(*_KEY, F.round("accuracy", 6).alias("accuracy"), F.round("fact_coverage", 6).alias("fact_coverage"), joined("matched_facts"),
                     "accurate_mention", "misrepresented")


@query("e3_signal_alignment", _BASE + f" SELECT {_ID}, round(signal_alignment, 6) AS signal_alignment FROM s")
def e3(spark, sf):
    return _scored(spark, sf).select(*_KEY, F.round("signal_alignment", 6).alias("signal_alignment"))


@query("e4_rank_scores", _BASE + f" SELECT {_ID}, cps AS competitive_position_score, (rank_position IS NOT NULL)::INT::DOUBLE AS rank_coverage_rate FROM s")
def e4(spark, sf):
    return A.rank_scores(_known(spark, sf)).select(*_KEY, "competitive_position_score", "rank_coverage_rate")


@query("e4_illegal_ranks", _BASE + f" SELECT {_ID}, rank_position, mode FROM raw WHERE rank_position IS NOT NULL AND (mode <> 'manual-import' OR rank_position < 1)")
def e4_illegal(spark, sf):
    return A.split_by_rank_rule(D.answers(spark, sf))[1].select(*_KEY, "rank_position", "mode")


_FLAGS = [name for name, _ in C.STABILITY_SIGNALS]


def _r2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def _pct(x: str) -> str:
    return f"CAST(floor(({x}) * 100 + 0.5) AS INTEGER)"


_PER_GROUP = ", ".join(
    [f"sum({x}) AS p_{x}" for x in _FLAGS]
    + [f"{_r2(f'median({x})')} AS {x}" for x in ("accuracy", "fact_coverage", "signal_alignment")]
)
_CONS = {x: _pct(f"greatest(p_{x}, n - p_{x}) / n") for x in _FLAGS}
_GROUPS = _BASE + f""", g0 AS (
  SELECT site_id, run_id, prompt_id, any_value(category) AS category, any_value(priority) AS priority, any_value(expected_signal) AS expected_signal,
    any_value(intent) AS intent, any_value(holdout) AS holdout, count(*) AS n, {_PER_GROUP}, {_r2("median(cps)")} AS competitive_position_score,
    count(rank_position) / count(*) AS rank_coverage_rate,
    list(DISTINCT locale) FILTER (locale IS NOT NULL) AS locales FROM s GROUP BY 1, 2, 3),
seen AS (
  SELECT site_id, run_id, prompt_id, string_agg(provider, ', ' ORDER BY o) AS provider FROM (
    SELECT site_id, run_id, prompt_id, provider, min(answer_ord) AS o FROM s GROUP BY 1, 2, 3, 4) AS x GROUP BY 1, 2, 3),
seen2 AS (
  SELECT site_id, run_id, prompt_id, string_agg(model, ', ' ORDER BY o) AS model FROM (
    SELECT site_id, run_id, prompt_id, model, min(answer_ord) AS o FROM s GROUP BY 1, 2, 3, 4) AS x GROUP BY 1, 2, 3),
g1 AS (
  SELECT *, {", ".join(f"{c} AS c_{x}" for x, c in _CONS.items())},
    {", ".join(f"(p_{x} * 2 > n)::INT AS {x}" for x in _FLAGS)} FROM g0),
groups AS (
  SELECT *, {_pct("(0.0::DOUBLE + " + " + ".join(f"c_{x} / 100.0::DOUBLE" for x in _FLAGS) + f") / {len(_FLAGS)}")} AS consensus_rate,
    list_filter([{", ".join(f"CASE WHEN c_{x} < 100 THEN '{label}' END" for x, label in C.STABILITY_SIGNALS)}], lambda v: v IS NOT NULL) AS shaky,
    CASE WHEN len(locales) = 1 THEN locales[1] WHEN len(locales) > 1 THEN 'mixed' END AS locale
  FROM g1 JOIN seen USING (site_id, run_id, prompt_id) JOIN seen2 USING (site_id, run_id, prompt_id))"""


@query("a10_prompt_groups", _GROUPS + f""" SELECT site_id, run_id, prompt_id, category, priority, expected_signal, intent, holdout, n AS sample_count,
    len(shaky) = 0 AS stable, consensus_rate, array_to_string(shaky, ', ') AS unstable_signals,
    CASE WHEN n > 1 AND len(shaky) > 0 THEN 'Signals varied across repeated samples: ' || array_to_string(shaky, ', ') || '.' END AS spread_note,
    {", ".join(_FLAGS)}, accuracy, fact_coverage, signal_alignment, competitive_position_score, round(rank_coverage_rate, 6) AS rank_coverage_rate, provider, model, locale FROM groups""")
def a10(spark, sf):
    df = G.prompt_groups(_scored(spark, sf)).drop("prompt")
    return df.withColumns({"unstable_signals": F.array_join("unstable_signals", ", "), "rank_coverage_rate": F.round("rank_coverage_rate", 6)})


_RATES = {
    "mention_rate": "mention", "accurate_mention_rate": "accurate_mention", "owned_citation_rate": "owned_citation", "trusted_citation_rate": "trusted_citation",
    "recommendation_rate": "recommendation", "misrepresentation_rate": "misrepresented", "competitor_exclusion_gap": "competitor_excluded",
    "fact_coverage_score": "fact_coverage", "accuracy_rate": "accuracy", "vavr": "vavr",
}
_W = "CASE priority WHEN 'high' THEN 1.5 WHEN 'low' THEN 0.75 ELSE 1.0 END::DOUBLE"
_SUM = _GROUPS + f""", w AS (SELECT *, CASE WHEN NOT holdout THEN {_W} END AS w FROM groups),
summary AS (
  SELECT site_id, run_id, count(*) FILTER (NOT holdout) AS prompt_count, count(*) FILTER (holdout) AS holdout_prompt_count,
    {", ".join(f"coalesce({_pct(f'sum({c} * w) / sum(w)')}, 0) AS {name}" for name, c in _RATES.items())},
    {_r2("sum(competitive_position_score * w) / sum(w) FILTER (competitive_position_score IS NOT NULL)")} AS competitive_position_score,
    count(*) FILTER (NOT holdout AND n > 1) AS repeated_prompt_count,
    coalesce({_pct("count(*) FILTER (NOT holdout AND n > 1 AND len(shaky) = 0) / nullif(count(*) FILTER (NOT holdout AND n > 1), 0)")}, 0) AS stable_prompt_rate,
    count(*) FILTER (NOT holdout AND n > 1 AND len(shaky) > 0) AS unstable_prompt_count FROM w GROUP BY 1, 2),
per_answer AS (
  SELECT site_id, run_id, count(*) AS sample_count, {_pct("count(*) FILTER (NOT holdout AND rank_position IS NOT NULL) / greatest(count(*) FILTER (NOT holdout), 1)")} AS rank_coverage_rate,
    CASE WHEN count(DISTINCT locale) = 1 THEN min(locale) WHEN count(DISTINCT locale) > 1 THEN 'mixed' END AS locale FROM s GROUP BY 1, 2),
full_summary AS (SELECT * FROM summary JOIN per_answer USING (site_id, run_id))"""


def _summary(spark, sf):
    return G.eval_summary(_groups(spark, sf), _scored(spark, sf))


@query("a11_eval_summary", _SUM + " SELECT * FROM full_summary")
def a11(spark, sf):
    return _summary(spark, sf)


_METRICS = ", ".join(f"{{'metric_ord': {i}, 'label': '{label}', 'v': {name}}}" for i, (name, label) in enumerate(C.DIFF_METRICS))


@query("w5_eval_diff", _SUM + f""", m AS (SELECT site_id, run_id, u.metric_ord AS metric_ord, u.label AS label, u.v AS current FROM (SELECT *, unnest([{_METRICS}]) AS u FROM full_summary) AS x)
  SELECT * EXCLUDE (generated_at) FROM (SELECT *, current - previous AS delta FROM (SELECT *, lag(current) OVER (PARTITION BY site_id, metric_ord ORDER BY generated_at, run_id) AS previous FROM m JOIN ({D.RUNS}) AS t USING (site_id, run_id)) AS y)""")
def w5(spark, sf):
    return G.eval_diff(_summary(spark, sf), D.derived(spark, sf, D.RUNS))


_SOME_BRANDS = f"SELECT * FROM ({D.ANSWER_BRANDS}) AS all_brands WHERE site_id NOT LIKE '%1'"


@query("e1_no_brand", f"SELECT site_id, run_id, answer_ord FROM ({D.ANSWERS}) AS a WHERE site_id NOT IN (SELECT site_id FROM ({_SOME_BRANDS}) AS b)")
def e1_no_brand(spark, sf):
    return A.split_by_brand(D.answers(spark, sf), D.derived(spark, sf, _SOME_BRANDS))[1].select("site_id", "run_id", "answer_ord")


_A12 = f"""SELECT {_ID}, category, intent, holdout, model, locale, rank_position, accurate_mention = 1 AS accurate_mention, owned_citation = 1 AS owned_citation,
    trusted_citation = 1 AS trusted_citation, recommendation = 1 AS recommended, misrepresented = 1 AS misrepresented, competitor_excluded = 1 AS competitor_excluded,
    round(fact_coverage, 6) AS fact_coverage, accurate_mention = 1 AND owned_citation = 0 AND trusted_citation = 0 AS citation_gap,
    array_to_string(competitor_mentions, '|') AS competitor_mentions, array_to_string(domains, '|') AS citation_domains,
    provider || '/' || prompt_id || CASE WHEN sample_index > 0 THEN '--sample-' || (sample_index + 1) ELSE '' END || '.json' AS raw_payload_file FROM s"""


@query("a12_citation_gaps", _BASE + " " + _A12)
def a12(spark, sf):
    df = A.citation_gaps(_scored(spark, sf)).drop("answer_ord")
    return df.withColumns({"fact_coverage": F.round("fact_coverage", 6), "competitor_mentions": F.array_join("competitor_mentions", "|"),
                           "citation_domains": F.array_join("citation_domains", "|")})


@query("a12_citation_gap_totals", _BASE + f""" SELECT site_id, run_id, count(*) AS sample_count, count(*) FILTER (citation_gap) AS citation_gap_count,
    count(*) FILTER (competitor_excluded) AS competitor_exclusion_gap_count, count(*) FILTER (misrepresented) AS misrepresentation_count FROM ({_A12}) AS x GROUP BY 1, 2""")
def a12_totals(spark, sf):
    return A.citation_gap_totals(A.citation_gaps(_scored(spark, sf)))


_EVAL_CTES = _SUM[len("WITH "):].replace("brands AS (", "brands_a AS (").replace("JOIN brands AS b", "JOIN brands_a AS b").replace("FROM brands UNION", "FROM brands_a UNION").replace("FROM brands\n", "FROM brands_a\n")
_EVAL_CTES = _EVAL_CTES.replace("facts AS (", "facts_a AS (").replace("FROM facts)", "FROM facts_a)").replace("competitors AS (", "competitors_a AS (").replace("JOIN competitors AS c", "JOIN competitors_a AS c").replace("\nraw AS", "\nraw_a AS")


@query("e6_apply_eval", P.with_issues(_SCORES, _EVAL_CTES) + " SELECT a.site_id, e.run_id, a.overall_score, coalesce(e.vavr, a.vavr) AS vavr, coalesce(e.sample_count, 0) AS sample_count, e.locale, "
       "CASE WHEN e.run_id IS NULL THEN 'audit' ELSE 'eval' END AS mode, a.crawled_pages FROM (" + _SUMMARY.format(vavr="CAST(NULL AS INTEGER) AS vavr", discovered="c.n") + ") AS a LEFT JOIN full_summary AS e USING (site_id)")
def e6(spark, sf):
    df = G.apply_eval(_audit_summary(spark, sf), _summary(spark, sf))
    return df.select("site_id", "run_id", "overall_score", "vavr", "sample_count", "locale", "mode", "crawled_pages")
