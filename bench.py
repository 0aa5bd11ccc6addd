"""Times of the headline queries on one machine: prints one JSON line.

BENCH_SF_DIR is the folder of tables (default /root/testdata/sf0.1), BENCH_CPUS the number of cores (default 8). Each
query runs once to warm up and then twice; its time is the mean of the two, with all rows computed and written nowhere.
"""

import json
import os
import statistics
import time

HEADLINE = ("q01_profile", "j03_join_path", "t07_t08_period_change", "r08_ols", "s05_mann_whitney", "n05_stability", "d01_compare", "a41_descriptive", "a43_rfm", "w03_w05_smoothed", "s14_ks", "k10_kaplan_meier")


def main() -> None:
    from pyspark.sql import SparkSession

    from millrace import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(3):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.mean(taken[1:]), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
