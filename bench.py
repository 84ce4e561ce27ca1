"""Wall-clock seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then REPEATS times; the median counts. Results are written to the noop sink, so that
whole results are made but not sent to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from brindle.plans import catalog
from brindle.session import get_session

HEADLINE = (
    "hybrid_search", "semantic_topk", "fulltext_match_topk", "chunk_fixed_tokens", "content_hash_dedup", "news_story_rank", "story_cluster", "news_day_feed",
    "notification_plan", "invoice_match_propose", "transaction_dedup_keys", "retrieval_metrics_by_kind", "latency_summary", "normalize_url", "html_to_text", "events_tumbling", "money_sums",
)
REPEATS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(REPEATS + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(median(times[1:]), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))


if __name__ == "__main__":
    main()
