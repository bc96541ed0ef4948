"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Seconds are the median of the runs after one untimed warm-up of the session; every result is
computed whole by a `noop` write.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from contractlake.plans import catalog
from contractlake.session import build_session

HEADLINE = (
    "compare_snapshots", "append_if_changed", "reachable", "shared_resources", "consumers", "doc_dependency_graph", "extract_endpoints",
    "diff_param_added", "diff_downstream", "changed_symbols", "merge_edges", "downstream_entries", "latest_versions", "endpoint_impact",
    "resolve_calls", "impacted_endpoints",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/part.parquet").groupBy("p_brand").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs):
            started = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(taken), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
