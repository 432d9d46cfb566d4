"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
local cores.  Each query runs once to warm up, then BENCH_RUNS times; the best
run counts.  Results go to the noop sink, so every column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedloom.plans import feeds, streams  # noqa: E402, F401
from feedloom.plans.catalog import QUERIES  # noqa: E402
from feedloom.session import build_session  # noqa: E402

HEADLINE = [
    "canonical_urls", "normalized_text", "evidence_passages", "title_gate", "gated_rows", "phrase_hit_lists",
    "priority_class", "year_class", "role_score", "overall_score", "score_bands", "fingerprints",
    "identity_match_tiers", "lifecycle_merge", "digest_rows", "run_summary", "detail_enrichment_capped",
    "source_health_fold", "source_health_step", "ranked_documents", "top_k_with_rest", "explore_by_score",
    "report_lines", "json_path_values", "page_text", "page_rows", "page_jsonld", "normalize_greenhouse",
    "normalize_workday", "normalize_generic", "stream_lifecycle", "stream_health",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        best = None
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt > 0:
                best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
