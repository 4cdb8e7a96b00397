"""Times the headline queries: one JSON line. BENCH_SF_DIR: tables (default sf0.1); BENCH_CPUS: threads of local mode."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewater import catalog  # noqa: E402

HEADLINES = [
    "filter_and", "project_expr", "agg_basic", "select_by", "select_by_two_keys", "count_distinct", "distinct", "sort_multi", "topk", "mcount_msum_mavg_mvar_mdev", "mmin_mmax", "moving_max_wide",
    "moving_avg_wide", "lj", "ij", "ej_first_match", "aj", "aj_sliced", "wj_lookback", "wj_multi_agg", "ohlc_bars", "vwap_twap", "ema", "xgroup_list", "update_by", "num_functions",
]
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINES:
        run(name)  # compiles code, fills file caches
        each = []
        for _ in range(RUNS):
            began = time.perf_counter()
            run(name)
            each.append(time.perf_counter() - began)
        times[name] = round(statistics.median(each), 4)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total of headline queries, median of 3 warm runs", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
