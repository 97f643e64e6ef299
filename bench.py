"""Times the headline queries; prints one JSON line.

Each query builds everything it needs: staged inputs are dropped before it starts.
"""

from __future__ import annotations

import json
import os
import platform
import tempfile
import time

from pyspark.sql import SparkSession

import catalog
from citeframe.session import tuned

HEADLINES = [
    "p1_extract_pages", "p3_flags_given", "p4_links_given", "a1_bucket_scores", "j1_incoming_links", "r_audit_issues", "w1_top_issues",
    "a10_prompt_groups", "a11_eval_summary", "a12_citation_gaps", "a7_aggregate_search", "j4_match_search_pages", "v3_blocker_findings",
    "c3_discover_urls", "c4_plan_targets", "d7_language_findings", "d11_broken_links", "x1_scan_policies", "x4_heading_anchors",
    "x5_doc_link_findings", "u6_keyword_coverage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="citeframe-"))
    builder = builder.config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
    spark = tuned(builder.config("spark.ui.showConsoleProgress", "false")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM code paths and the Python workers once, outside the timing
    catalog.QUERIES["p1_extract_pages"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        catalog.forget()
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, staged inputs rebuilt per query, after one warm-up query", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "spark": spark.version,
                "cpus": int(cpus), "driver_memory": "16g", "python": platform.python_version(),
            }
        )
    )


if __name__ == "__main__":
    main()
