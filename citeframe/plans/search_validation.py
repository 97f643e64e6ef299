"""Search validation: export rows against audited pages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from citeframe.operators import search as S
from citeframe.session import stage


def validate_search(rows: DataFrame, pages: DataFrame, issues: DataFrame, sites: DataFrame, source: str) -> dict[str, DataFrame]:
    """Coverage, findings, summary and top pages of one source (console or webmaster export)."""
    if source not in ("search-console", "bing-webmaster"):
        raise ValueError(f"unknown search source {source}")
    mine = rows.filter(rows.source == source)
    matched = stage(S.match_search_pages(S.aggregate_search(mine), pages, issues, sites), "search-pages")
    coverage = S.key_page_coverage(pages, matched, source)
    findings = S.no_evidence_findings(coverage).unionByName(S.not_crawled_findings(matched))
    findings = findings.unionByName(S.blocker_findings(matched))
    return {
        "search_pages": matched,
        "key_page_coverage": coverage,
        "search_findings": findings,
        "search_summary": S.search_summary(matched, coverage),
        "top_search_pages": S.top_search_pages(matched),
    }
