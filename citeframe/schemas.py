"""Table schemas."""

from __future__ import annotations

from pyspark.sql.types import StructType

RAW_LINK = "struct<href:string,text:string,aria:string,title:string,block:string,heading:string>"

SCHEMAS = {
    "pages_raw": "site_id string, url string, status int, content_type string, fetch_error string, html string",
    "robots_raw": "site_id string, text string",
    "sitemaps_raw": "site_id string, sitemap_url string, xml string",
    "sites": "site_id string, base_url string",
    "brands": "site_id string, name string, domain string, category string, one_liner string, "
    "personas array<string>, use_cases array<string>, trusted_domains array<string>",
    "brand_facts": "site_id string, fact_ord int, fact_id string, fact_type string, text string",
    "competitors": "site_id string, comp_ord int, name string, domain string, category string",
    "prompts": "site_id string, prompt_id string, prompt_ord int, category string, template string, "
    "expected_signal string, priority string, intent string, holdout boolean, locale string",
    "answers": "site_id string, run_id string, answer_ord long, prompt_id string, sample_index int, "
    "provider string, model string, answer_text string, locale string, rank_position int, mode string, "
    "citations array<struct<url:string,title:string,owned:boolean,trusted:boolean>>",
    "search_rows": "site_id string, source string, row_no long, page string, clicks double, "
    "impressions double, ctr double, position double",
    "documents": "doc_id long, text string",
    "page_parts": "title string, meta_description string, h1 string, h1_count int, "
    "headings array<string>, lists int, tables int, scripts int, canonical string, robots_meta string, "
    "aria_controls int, controls int, refresh string, body_text string, site_text string, "
    f"raw_links array<{RAW_LINK}>, jsonld_nodes array<string>, jsonld_depths array<int>, jsonld_invalid int, "
    "metas array<struct<name:string,content:string>>, alternates array<struct<hreflang:string,href:string>>",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])
