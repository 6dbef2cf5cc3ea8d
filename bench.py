"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "bm25_topk",
    "term_stats",
    "vector_topk",
    "budgeted_pick",
    "majority_vote",
    "grade_ladder",
    "run_summary",
    "compare_versions",
    "numeric_sum_check",
    "classification_metrics",
    "cost_ledger",
    "audit_chain",
    "sliding_limit",
    "billing_interval_join",
    "external_match",
    "boilerplate_lines",
    "iou_pairs",
    "nearest_blocks",
    "reconcile_items",
    "payload_dedupe",
    "claim_listing",
    "text_nodes",
)


def main() -> None:
    from claimgrove.session import local_session
    from workload import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
