"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
    BENCH_QUERIES (comma-separated names, or "all")
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import checks  # noqa: E402

HEADLINE = (
    "daily_extremes_with_season", "merge_weather_flow_filled", "smooth_temperatures", "sliding_windows",
    "standardize", "one_hot", "nearest_fit_station", "has_all_fields_by_day", "flow_rdb", "swe_to_daily",
    "points_in_polygons", "assign_watershed", "clip_cells_all_touched", "zonal_mean_expanding",
    "grid_availability", "granules_for_requests", "clean_rings", "simplify_rings", "stations_usgs",
    "normalize", "build_dataset", "huc_soil_moisture")


def main() -> None:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(checks.QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or list(HEADLINE)
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("freshet-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    checks.QUERIES["daily_extremes"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in names:
        start = time.perf_counter()
        checks.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline query seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
