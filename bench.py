"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list),
BENCH_RUNS (default 1 timed run after one warm-up of the session).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clickloom.plans.catalog import QUERIES  # noqa: E402
from clickloom.session import local_session  # noqa: E402

HEADLINE = [
    "enrich",
    "home_funnel_window",
    "latest_window_feature",
    "user_features",
    "item_features",
    "running_user_features",
    "user_sliding_stat",
    "item_sliding_stat",
    "latest_stat",
    "decayed_cross_category",
    "decayed_cross_brand",
    "seq_pv",
    "seq_query",
    "candidate_pool",
    "rule_recommend",
    "stage_counts",
    "filter_reason_stats",
    "rec_quality",
    "hotspot_share",
    "item_cf_similarity",
    "item_cf_recommend",
    "user_cf_similarity",
    "category_recall",
    "exact_topk_cosine",
    "graph_propagate",
    "sample_negatives",
    "prepare_rank_features",
    "tumbling_1min",
    "dim_join_stream",
    "sequence_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus=cpus, memory=os.environ.get("BENCH_MEMORY", "12g"), app="clickloom-bench")
    QUERIES["user_totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    n_events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    result = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus),
        "events_per_sec": {n: round(n_events / times[n]) for n in ("dim_join_stream", "tumbling_1min") if n in times},
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
