"""Time the headline queries and print one JSON line.

Each query runs once to warm up and three times for the median; results go to Spark's noop
sink, so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from linkloom.plans.catalog import queries
from linkloom.session import local_session

HEADLINE = [
    "j1_latest_results",
    "j2_wide_by_id",
    "j5_disagreements",
    "j6_plurality",
    "j7_model_scores",
    "j17_consensus_depth",
    "k11_metrics",
    "k12_per_class",
    "k13_confusion",
    "h3_analytics",
    "h5_categories_with_counts",
    "h7_dashboard",
    "b6_search_plain",
    "l2_distinct_links",
    "l4_split_known",
    "d6_round_robin",
    "c2_route_by_rules",
    "c7_normalize_answers",
    "p1_titles",
    "k4_dataset",
]
RUNS = 3


def timed(build, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "linkloom-bench")
    known = queries()
    seconds = {}
    for name in HEADLINE:
        timed(known[name], spark, sf_dir)
        seconds[name] = round(statistics.median(timed(known[name], spark, sf_dir) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
