"""Times the headline queries. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names). Each query runs once to warm up and once timed, its rows fully produced.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from routewatch.catalog import QUERIES  # noqa: E402
from routewatch.session import get_spark  # noqa: E402

HEADLINE = [
    "classify_updates", "w2_session_changes", "a3_prefix_counts", "a1_rolling_10m", "j1_longest_prefix_match",
    "j3_rpki_validation", "j5_provider_edges", "d4_leak_patterns", "s1_ris_json", "s4_geo_enrich", "a8_covered_ipv4",
    "a12_summary_classes", "a14_alerts", "w6_ewma_states", "w7_rate_limit", "w8_rolling_rate", "t7_transitions",
    "a15_tiles", "a25_map_cells", "f18_ranges_to_cidrs",
]


def run(spark, sf_dir, name):
    start = time.perf_counter()
    # the noop sink produces every row without bringing rows to the driver
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = get_spark(f"local[{cpus}]", int(cpus), "routewatch-bench")
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in names:
        run(spark, sf_dir, name)
        times[name] = round(run(spark, sf_dir, name), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "routewatch headline queries, total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
