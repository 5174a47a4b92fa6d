"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores. Each query runs
twice and the second run counts, so that JVM start-up and code generation are
not measured; the rate card is built once before, as a user would.
"""

from __future__ import annotations

import json
import os
import re
import time

from spendlens.plans import analytics, catalog
from spendlens.session import local_session

HEADLINES = [
    "a2_stats_by_model",
    "a1_stats_by_provider",
    "a3_stats_by_client",
    "a10_latency_percentiles_approximate",
    "a11_unpriced_models",
    "a13_verdict_over",
    "a15_spend_by_source_and_model",
    "a16_cache_decay",
    "k1_tail",
    "n9_sse_events",
    "n28_records",
    "n28_stream_records",
    "p1_rate_lookup_by_catalogue",
    "p7_call_cost",
    "s2_new_calls",
    "v3_avoidable_misses",
    "v5_substitutions",
    "v6_evaluation_bursts",
    "h1_stream_records",
    "h4_running_spend",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "spendlens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    analytics.card(spark)
    queries = catalog.queries()
    seconds = {}
    for key in HEADLINES:
        for _ in range(2):
            start = time.perf_counter()
            queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[key] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale[1]) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
