"""Headline queries, timed once warm: prints one JSON line."""
from __future__ import annotations

import json
import os
import time

from plansift.plans import registered
from plansift.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = (
    "search_pages", "bm25_top", "hybrid_candidates", "semantic_topk", "postings", "refs_in_text", "clean_text",
    "snippet", "headings", "part_search", "ref_position_search", "find_ref_in_question", "merged_designation",
    "photo_left_lookup", "photo_only_refs", "figures_per_page", "marks_in_figures", "hash_similarity",
    "best_region_per_image", "list_documents", "replace_groups", "recent_history",
    "suggestions", "broad_flag", "ocr_highlights", "stored_neighbours", "pages_using_ref",
)


def run(spark, name: str) -> float:
    start = time.perf_counter()
    registered.queries()[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        run(spark, name)  # warm-up: code generation and file listing
        times[name] = round(run(spark, name), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
