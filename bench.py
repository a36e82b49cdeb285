"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder and BENCH_CPUS the local cores. BENCH_QUERIES picks other queries by name, or
``all``. Each query is run once to warm up and then timed (best of BENCH_RUNS), its rows written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from entityflow.plans import QUERIES  # noqa: E402

HEADLINE = (
    "join_collection_star", "agg_collection_stats", "topk_value_page", "agg_progress_snapshot", "join_hamming_knn",
    "join_hamming_ensemble", "join_cosine_knn", "join_fuzzy_resolve", "cascade_decide", "cascade_identify",
    "win_quota_clamp", "st_quota_admit", "st_rate_limit", "variant_narrow", "price_resolve", "price_refresh",
    "apply_reviews", "win_cap_newest", "agg_eval_metrics", "index_build",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    picked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if picked == "all" else picked.split(",") if picked else list(HEADLINE)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("entityflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        best = None
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if i and (best is None or took < best):
                best = took
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
