"""Answer evaluation: answers to scores, consensus, run summary and diff."""

from __future__ import annotations

from pyspark.sql import DataFrame

from citeframe.operators import answers as A
from citeframe.operators import consensus as G
from citeframe.session import stage


def evaluate(answers: DataFrame, prompts: DataFrame, brands: DataFrame, facts: DataFrame, competitors: DataFrame,
             runs: DataFrame) -> dict[str, DataFrame]:
    """Score tables of all runs; answers with an unknown prompt, an illegal rank or a site without a brand come back as rejects.

    ``runs`` holds site_id, run_id and generated_at of each run, for the comparison with the run before.
    """
    ranked, bad_rank = A.split_by_rank_rule(answers)
    known, unknown = A.answers_with_prompts(ranked, prompts)
    known, without_brand = A.split_by_brand(known, brands)
    known = A.with_site_dims(known, brands, facts, competitors)
    scores = stage(A.score_answers(A.score_citations(known, brands), brands, facts, competitors), "answer-scores")
    groups = stage(G.prompt_groups(scores), "prompt-groups")
    summary = G.eval_summary(groups, scores)
    gaps = A.citation_gaps(scores)
    return {
        "answer_scores": scores,
        "prompt_groups": groups,
        "eval_summary": summary,
        "eval_diff": G.eval_diff(summary, runs),
        "citation_gaps": gaps,
        "citation_gap_totals": A.citation_gap_totals(gaps),
        "unknown_prompts": unknown,
        "illegal_ranks": bad_rank,
        "answers_without_brand": without_brand,
    }
