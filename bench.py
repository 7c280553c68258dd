"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import sys
import time

from gridwarden.session import build_session
from gridwarden.workload import QUERIES

HEADLINE = (
    "build_daily_indicators",
    "daily_reduce",
    "deaccumulate_daily",
    "rolling_precip",
    "nearest_time_select",
    "regrid_bilinear",
    "vapor_integrals",
    "scan_risks",
    "province_lookup",
    "province_day_mean",
    "region_day_topk_pool",
    "region_season_aggregate",
    "merge_event_sources",
    "label_flash_flood_grid",
    "label_extreme_heat",
    "supervised_join_flash_flood",
    "warning_product",
    "stream_daily_precip",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
