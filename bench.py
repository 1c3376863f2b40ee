"""Times the headline queries and prints one JSON line.

Each query runs to completion (every result row is produced and dropped); plan building is part of its time.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from spoor.catalog import load_all
from spoor.session import build_session

HEADLINE = (
    "flamegraph_tree", "flamegraph_weighted", "diff_join", "facets", "poll_hist_samples", "span_member_filter", "spawn_loc_stats",
    "worker_activity", "period_stats", "top_long_polls", "polls", "readiness", "point_in_interval", "sched_delays", "pair_lifo",
    "spans_enter_exit", "span_stats", "composition_hist", "attribute_facets", "point_in_overlapping_intervals", "span_depth",
    "counter_series", "alloc_sites", "alloc_free_match", "coverage", "red_flags", "stateful_polls")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start-up is not part of the first query
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
