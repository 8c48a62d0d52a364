"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the number of cores.
Every query is run once to warm up and then BENCH_RUNS times (default 3); the
median counts.  Results go to the ``noop`` sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from fillgauge.queries import QUERIES
from fillgauge.session import build_session, clear_work

HEADLINE = [
    "load_latest_version", "load_versions", "missing_mcar", "missing_mar_max", "missing_company",
    "missing_mnar_max", "agg_median", "agg_percentile", "agg_mode", "impute_group_median",
    "metrics_all", "eval_summary", "smd_most_frequent", "hist_table", "ecdf_table", "qq_table",
    "folds_stratified", "rare_apply_valid", "predict_inverse",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        seconds = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
            clear_work(spark)
        times[name] = round(statistics.median(seconds[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
