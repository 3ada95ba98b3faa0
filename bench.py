"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Every query runs to the end: all its rows are produced and dropped (``noop`` sink).  One untimed query
warms the JVM first.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallyglass.plans import load
from tallyglass.session import local_session

HEADLINE = (
    "sheet_aggregate", "sheet_filter", "conditional_totals", "missed_targets", "eval_summary", "doc_stats",
    "price_on_or_after", "next_day_return", "polarity_scores", "stock_summary",
    "chunk_fixed", "chunk_recursive", "chunk_by_paragraph", "pack_rows", "html_sections", "archive_entries",
    "hash_embed", "vector_topk", "mmr_topk", "search", "build_prompts", "suggest_symbols", "find_symbol",
    "idle_sessions", "daily_quota", "rate_limit",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main(wanted: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    queries, _ = load()
    run(queries["sheet_aggregate"](spark, sf_dir))
    seconds: dict[str, float] = {}
    for key in wanted or HEADLINE:
        start = time.perf_counter()
        run(queries[key](spark, sf_dir))
        seconds[key] = round(time.perf_counter() - start, 3)
        print(key, seconds[key], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall-clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main(sys.argv[1:])
