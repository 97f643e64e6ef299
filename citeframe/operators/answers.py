"""Answer scoring: prompts, citations, facts, ranks, signals (native columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe import constants as C
from citeframe.functions import text as T
from citeframe.functions import urls as U
from citeframe.functions.numbers import clamp, rank_score
from citeframe.operators.phrases import with_names
from citeframe.operators.joins import lookup_join

ANSWER_KEY = ["site_id", "run_id", "prompt_id", "provider", "sample_index"]


def sampling_plan(prompts: DataFrame, samples: int, locale: str | None = None) -> DataFrame:
    """Every prompt times every sample index; the prompt's own locale wins over the run's."""
    return prompts.select(
        "site_id", "prompt_id", "prompt_ord",
        F.coalesce("locale", F.lit(locale).cast("string")).alias("locale"),
        F.coalesce("holdout", F.lit(False)).alias("holdout"),
        F.lit(samples).alias("run_count"),
        F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_index"),
    )


def unique_prompts(prompts: DataFrame) -> DataFrame:
    """One prompt per id, the last one listed."""
    kept = [c for c in prompts.columns if c not in ("site_id", "prompt_id")]
    last = prompts.groupBy("site_id", "prompt_id").agg(F.max_by(F.struct(*kept), "prompt_ord").alias("p"))
    return last.select("site_id", "prompt_id", "p.*")


def answers_with_prompts(answers: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers with their prompt's attributes and defaults, and the answers whose prompt is unknown."""
    p = unique_prompts(prompts).select(
        "site_id", "prompt_id", "category", F.col("template").alias("prompt"), "expected_signal", "intent",
        F.coalesce("priority", F.lit("medium")).alias("priority"),
        F.coalesce("holdout", F.lit(False)).alias("holdout"),
        F.col("locale").alias("_prompt_locale"),
    )
    known = lookup_join(answers.drop("holdout"), p, ["site_id", "prompt_id"])
    known = known.withColumn("locale", F.coalesce("locale", "_prompt_locale")).drop("_prompt_locale")
    unknown = lookup_join(answers, p.select("site_id", "prompt_id"), ["site_id", "prompt_id"], "left_anti")
    return known, unknown


def split_by_rank_rule(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers with a legal rank, and the others: ranks are positive and only come with manual imports."""
    legal = F.col("rank_position").isNull() | (
        (F.coalesce("mode", F.lit("eval")) == "manual-import") & (F.col("rank_position") >= 1)
    )
    return answers.filter(legal), answers.filter(~legal)


def rank_scores(answers: DataFrame) -> DataFrame:
    """Adds the competitive position score and whether a rank is known."""
    return answers.withColumns(
        {
            "competitive_position_score": rank_score(F.col("rank_position")),
            "rank_coverage_rate": F.when(F.col("rank_position").isNull(), 0.0).otherwise(1.0),
        }
    )


def _brand_columns(brands: DataFrame) -> DataFrame:
    return brands.select("site_id", F.col("domain").alias("brand_domain"), F.col("trusted_domains").alias("brand_trusted"))


def score_citations(answers: DataFrame, brands: DataFrame) -> DataFrame:
    """Fills domain, owned and trusted of the nested citations; values given with the answer win."""
    df = answers if "brand_domain" in answers.columns else answers.join(_brand_columns(brands), "site_id", "left")

    def fill(c: Column) -> Column:
        def rated(domain: Column) -> Column:
            return F.struct(
                c["url"].alias("url"),
                domain.alias("domain"),
                c["title"].alias("title"),
                F.coalesce(c["owned"], U.domain_in(domain, F.col("brand_domain")), F.lit(False)).alias("owned"),
                F.coalesce(c["trusted"], U.domain_in_any(domain, F.col("brand_trusted"))).alias("trusted"),
            )

        return T.let(U.url_domain(c["url"]), rated)

    return df.withColumn("citations", F.transform("citations", fill)).drop("brand_domain", "brand_trusted")


def explode_citations(answers: DataFrame) -> DataFrame:
    """Long citation table."""
    return answers.select(*ANSWER_KEY, F.posexplode("citations").alias("cit_ord", "c")).select(*ANSWER_KEY, "cit_ord", "c.*")


def competitor_mentions(texts: DataFrame, competitors: DataFrame, text: str = "answer_text") -> DataFrame:
    """Adds ``competitor_mentions``: names of the site's competitors found in the text, in declared order.

    Texts that carry their site's ``rivals`` are compared with those; others meet an index of the names, whose cost
    does not depend on the number of names of a site.
    """
    if "rivals" in texts.columns:
        df = texts.withColumn("_lower", F.lower(text))
        named = F.filter(F.coalesce("rivals", F.array().cast("array<string>")), lambda n: F.contains(F.col("_lower"), F.lower(n)))
        return df.withColumn("competitor_mentions", named).drop("rivals", "_lower")
    names = competitors.select("site_id", F.col("comp_ord").alias("ord"), "name", F.lower("name").alias("needle"))
    df = with_names(texts, names, F.lower(F.coalesce(F.col(text), F.lit(""))), "_found")
    return df.withColumn("competitor_mentions", F.transform("_found", lambda x: x["name"])).drop("_found")


def _rival_columns(competitors: DataFrame) -> DataFrame:
    names = competitors.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("comp_ord", "name"))).alias("_c"))
    return names.select("site_id", F.col("_c.name").alias("rivals"))


def split_by_brand(answers: DataFrame, brands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers of sites with a brand, and those without one, which nothing can score."""
    sites = brands.select("site_id").distinct()
    return answers.join(sites, "site_id", "left_semi"), answers.join(sites, "site_id", "left_anti")


def with_site_dims(answers: DataFrame, brands: DataFrame, facts: DataFrame, competitors: DataFrame) -> DataFrame:
    """Adds all brand, fact and competitor columns in one join; the scoring steps then need none.

    The dimensions are one row per site. Answers of sites without a brand are left out, as there is
    nothing to score them against; ``split_by_brand`` returns them.
    """
    dims = fact_list(brands, facts).join(_brand_columns(brands), "site_id")
    dims = dims.join(_rival_columns(competitors), "site_id", "left")
    return answers.join(dims, "site_id")


def fact_list(brands: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts per brand: name and category, the one-liner, then the declared facts; with their tokens."""
    listed = facts.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("fact_ord", "text"))).alias("_f"))
    df = brands.join(listed, "site_id", "left")
    opening = F.concat(F.col("name"), F.lit(" is a "), F.col("category"), F.lit("."))
    texts = F.concat(
        F.array(opening, F.col("one_liner")), F.coalesce(F.col("_f.text"), F.array().cast("array<string>"))
    )
    rows = F.transform(
        texts, lambda t, i: F.struct(i.alias("ord"), t.alias("fact"), F.array_distinct(T.keyword_tokens(t)).alias("tokens"))
    )
    return df.select("site_id", F.col("name").alias("brand_name"), rows.alias("facts"))


def fact_accuracy(answers: DataFrame, brands: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds mention, accuracy, fact_coverage, matched_facts, accurate_mention and misrepresented.

    Accuracy is the mean coverage of the two best covered facts; a fact covered by half or more
    counts as matched. The fact list of a site is one array row, so answers are joined once and
    never multiplied.
    """
    df = answers if "facts" in answers.columns else answers.join(fact_list(brands, facts), "site_id")
    df = df.withColumn("_lower", F.lower("answer_text"))
    df = df.withColumn("mention", F.contains(F.col("_lower"), F.lower("brand_name")).cast("int"))
    scored = F.transform(
        "facts",
        lambda f: F.struct(
            (-T.token_coverage(F.col("_lower"), f["tokens"])).alias("order"), f["ord"].alias("ord"), f["fact"].alias("fact")
        ),
    )
    df = df.withColumn("_ranked", F.when(F.col("mention") == 1, F.array_sort(scored)))
    best = F.slice("_ranked", 1, 2)
    mean = F.aggregate(best, F.lit(0.0), lambda acc, f: acc - f["order"], lambda acc: acc / F.size(best))
    matched = F.transform(F.filter("_ranked", lambda f: f["order"] <= -0.5), lambda f: f["fact"])
    df = df.withColumns(
        {
            "accuracy": F.coalesce(clamp(mean, 0.0, 1.0), F.lit(0.0)),
            "matched_facts": F.coalesce(matched, F.array().cast("array<string>")),
        }
    )
    return df.withColumns(
        {
            "fact_coverage": F.size("matched_facts") / F.size("facts"),
            "accurate_mention": ((F.col("mention") == 1) & (F.col("accuracy") >= 0.5)).cast("int"),
            "misrepresented": ((F.col("mention") == 1) & (F.col("accuracy") < 0.35)).cast("int"),
        }
    ).drop("_lower", "_ranked", "facts")


def signal_alignment(scores: DataFrame) -> DataFrame:
    """Adds ``signal_alignment``: the mean of the parts the prompt's expected signal asks for."""
    accurate, advised = F.col("accurate_mention"), F.col("recommendation")
    cited = F.greatest("owned_citation", "trusted_citation")
    kind = F.col("expected_signal")
    value = (
        F.when(kind == "mention_or_recommend", (accurate + advised) / 2)
        .when(kind == "mention_position_accuracy", (accurate + F.col("accuracy")) / 2)
        .when(kind.isin("citation_and_presence", "mention_or_citation"), (accurate + cited) / 2)
        .when(
            kind.isin("brand_accuracy", "brand_accuracy_balance"),
            (accurate + F.col("fact_coverage") + (1 - F.col("misrepresented"))) / 3,
        )
        .otherwise((accurate + cited + advised) / 3)
    )
    return scores.withColumn("signal_alignment", value)


def score_answers(answers: DataFrame, brands: DataFrame, facts: DataFrame, competitors: DataFrame) -> DataFrame:
    """All scores of each answer.

    ``answers`` already carries its prompt's attributes (``answers_with_prompts``) and rated
    citations (``score_citations``). Citations are nested, so their flags need no aggregation.
    """
    df = competitor_mentions(fact_accuracy(answers, brands, facts), competitors)
    lower = F.lower("answer_text")
    advised = T.has_any(lower, T.string_array(C.RECOMMENDATION_PHRASES))
    owned = F.coalesce(F.exists("citations", lambda c: c["owned"]), F.lit(False))
    trusted = F.coalesce(F.exists("citations", lambda c: c["trusted"]), F.lit(False))
    df = df.withColumns(
        {
            "owned_citation": owned.cast("int"),
            "trusted_citation": trusted.cast("int"),
            "recommendation": ((F.col("mention") == 1) & advised).cast("int"),
            "competitor_excluded": ((F.col("mention") == 0) & (F.size("competitor_mentions") > 0)).cast("int"),
        }
    )
    cited = (F.col("owned_citation") == 1) | (F.col("trusted_citation") == 1)
    df = df.withColumn("vavr", ((F.col("accurate_mention") == 1) & cited).cast("int"))
    return signal_alignment(rank_scores(df))


def payload_file(answers: DataFrame) -> DataFrame:
    """Adds the file key of the stored raw payload: provider folder, prompt id, sample suffix from the second on."""
    suffix = F.when(
        F.col("sample_index") > 0, F.concat(F.lit("--sample-"), (F.col("sample_index") + 1).cast("string"))
    ).otherwise(F.lit(""))
    return answers.withColumn("raw_payload_file", F.concat("provider", F.lit("/"), "prompt_id", suffix, F.lit(".json")))


def citation_gaps(scores: DataFrame) -> DataFrame:
    """One row per answer: accurate mention without an owned or trusted citation is a gap."""
    cited = (F.col("owned_citation") == 1) | (F.col("trusted_citation") == 1)
    domains = F.array_distinct(F.filter(F.transform("citations", lambda c: c["domain"]), lambda d: F.length(d) > 0))
    df = payload_file(scores)
    return df.select(
        *ANSWER_KEY, "answer_ord", "category", "intent", "holdout", "model", "locale", "rank_position",
        (F.col("accurate_mention") == 1).alias("accurate_mention"),
        (F.col("owned_citation") == 1).alias("owned_citation"),
        (F.col("trusted_citation") == 1).alias("trusted_citation"),
        (F.col("recommendation") == 1).alias("recommended"),
        (F.col("misrepresented") == 1).alias("misrepresented"),
        (F.col("competitor_excluded") == 1).alias("competitor_excluded"),
        "fact_coverage",
        ((F.col("accurate_mention") == 1) & ~cited).alias("citation_gap"),
        "competitor_mentions", F.coalesce(domains, F.array().cast("array<string>")).alias("citation_domains"),
        "raw_payload_file",
    )


def citation_gap_totals(gaps: DataFrame) -> DataFrame:
    """Gap, exclusion and misrepresentation counts per run."""
    return gaps.groupBy("site_id", "run_id").agg(
        F.count("*").alias("sample_count"),
        F.count_if("citation_gap").alias("citation_gap_count"),
        F.count_if("competitor_excluded").alias("competitor_exclusion_gap_count"),
        F.count_if("misrepresented").alias("misrepresentation_count"),
    )


