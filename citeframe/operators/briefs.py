"""Content briefs chosen from the audit's gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeframe.functions import text as T
from citeframe.operators.scores import first_per_site


def content_briefs(issues: DataFrame, missing: DataFrame, brands: DataFrame, facts: DataFrame, competitors: DataFrame) -> DataFrame:
    """FAQ, compare and use-case briefs of the sites that need them.

    A brief is due when its page type is missing or a matching issue exists. Only counts and the
    first three issue titles per site are gathered, never the issue list.
    """
    gaps = missing.groupBy("site_id").agg(
        F.count_if(F.col("page_type") == "faq").alias("no_faq"), F.count_if(F.col("page_type") == "compare").alias("no_compare")
    )
    raised = issues.groupBy("site_id").agg(
        F.count_if(F.col("category") == "evidence").alias("n_evidence"),
        F.count_if(F.col("category") == "comparison").alias("n_comparison"),
        F.count_if(F.col("rule_id") == "R44").alias("n_thin"),
    )
    relevant = issues.filter(F.col("category").isin("coverage", "evidence"))
    first = first_per_site(relevant.select("site_id", "issue_seq", "title"), ["issue_seq"], 3, "n")
    titles = first.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("n", "title"))).alias("_t"))
    names = competitors.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("comp_ord", "name"))).alias("_c"))
    told = facts.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("fact_ord", "text"))).alias("_f"))
    df = brands.drop("domain")
    for side in (gaps, raised, titles, names, told):
        df = df.join(side, "site_id", "left")
    df = df.na.fill(0, ["no_faq", "no_compare", "n_evidence", "n_comparison", "n_thin"])
    empty = F.array().cast("array<string>")
    name = F.col("name")
    declared = F.coalesce(F.col("_f.text"), empty)
    opening = F.array(F.concat(name, F.lit(" is a "), F.col("category"), F.lit(".")), F.col("one_liner"))
    claims = F.slice(F.concat(opening, declared), 1, 3)
    rivals = F.array_join(F.slice(F.coalesce(F.col("_c.name"), empty), 1, 3), ", ")
    rivals = T.let(rivals, lambda r: F.when(F.length(r) > 0, r).otherwise(F.lit("category alternatives")))
    use_case = F.coalesce(F.get("use_cases", F.lit(0)), F.lit("improve product onboarding"))
    persona = F.get("personas", F.lit(0))

    def brief(n: int, kind: str, due, title, audience, angle, outline, claims, call):
        return F.when(
            due,
            F.struct(
                F.lit(n).alias("brief_ord"), F.lit(f"{kind}-brief").alias("brief_id"), F.lit(kind).alias("type"),
                F.concat(name, F.lit(title)).alias("title"), audience.alias("audience"), F.lit(angle).alias("angle"),
                outline.alias("outline"), claims.alias("claims"), F.lit(call).alias("call_to_action"),
            ),
        )

    asks = F.transform(F.coalesce(F.col("_t.title"), empty), lambda t: F.concat(F.lit("Cover: "), t))
    rows = F.array(
        brief(
            1, "faq", (F.col("no_faq") > 0) | (F.col("n_evidence") > 0), " FAQ outline",
            F.coalesce(persona, F.lit("product and growth teams")),
            "Settle what buyers keep asking, each answer with a source.",
            F.concat(
                F.array(
                    F.concat(F.lit("What "), name, F.lit(" does and whom it serves")),
                    F.concat(F.lit("How "), name, F.lit(" compares")),
                    F.lit("Proof of fit, pricing and security"),
                ),
                asks,
            ),
            claims,
            "From each answer, lead on to prices, security and documents.",
        ),
        brief(
            2, "compare", (F.col("no_compare") > 0) | (F.col("n_comparison") > 0), " compare page outline",
            F.lit("buyers evaluating alternatives"),
            "Say plainly whom the product fits and whom it does not.",
            F.array(
                F.concat(F.lit("Whom "), name, F.lit(" suits")),
                F.concat(name, F.lit(" next to "), rivals),
                F.lit("Table of features, pricing and onboarding"),
                F.lit("Criteria by team and workflow"),
            ),
            F.concat(F.array("one_liner"), F.slice(declared, 1, 2)),
            "Close with the ways to read on, see prices or try it.",
        ),
        brief(
            3, "use-case", F.col("n_thin") > 0, " use-case page outline",
            F.coalesce(persona, F.lit("teams evaluating tools")),
            "Show one job done, with results that can be cited.",
            F.array(
                F.concat(F.lit("The problem: "), use_case),
                F.concat(F.lit("How "), name, F.lit(" handles "), use_case),
                F.lit("Recommended workflow"),
                F.lit("Proof and next step"),
            ),
            claims,
            "Lead on to a first step for this very job.",
        ),
    )
    kept = F.filter(rows, lambda b: b.isNotNull())
    return df.select("site_id", F.explode(kept).alias("b")).select("site_id", "b.*")
