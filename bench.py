"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from corpus_engine.registry import all_queries
from tests.session import make_session

HEADLINES = (
    "corpus_summary", "chunk_pages", "split_by_size", "near_boilerplate", "remove_boilerplate", "shingles",
    "dedupe_lines", "postings", "vector_search", "keyword_index", "cover_density_rank", "keyword_top", "hybrid_search", "search_knowledge",
    "extract_pages", "extract_links", "crawl_order", "dedupe_urls", "classify_pages", "upsert_pages",
    "diff_chunks", "page_line_diff", "site_analytics", "messages_by_day", "usage_summary", "model_usage",
    "failure_streaks", "sliding_counts", "previous_version", "rate_limit", "accessible_sites", "job_metrics",
    "ann_search", "ingest_stream", "link_stats", "citations", "index_quality", "incremental_ingest", "embed_pages",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = make_session()
    registered = all_queries()
    # start Python workers and code generation once
    registered["extract_pages"].run(spark, directory).limit(1).collect()
    times = {}
    for name in HEADLINES:
        start = time.time()
        registered[name].run(spark, directory).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
