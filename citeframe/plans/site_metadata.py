"""Metadata consistency of whole sites."""

from __future__ import annotations

from pyspark.sql import DataFrame

from citeframe.operators.features import page_features
from citeframe.operators.metadata import metadata_findings
from citeframe.session import stage
from citeframe.sources.site_files import parse_sitemaps


def check_sites(pages_raw: DataFrame, sitemaps_raw: DataFrame, sites: DataFrame, version: str) -> DataFrame:
    """Findings of all families over one staged feature table."""
    pages = stage(page_features(pages_raw, sites, keep_site_text=True), "site-features")
    locs, _ = parse_sitemaps(sitemaps_raw)
    return metadata_findings(pages, locs, sites, version)
