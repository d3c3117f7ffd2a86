"""Run the headline queries and print one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "binned_means",
    "score_sample",
    "sample_groups",
    "match_by_id",
    "match_rejected",
    "combine_matches",
    "property_table",
    "build_activity_flags",
    "match_stands",
    "point_in_polygon",
    "match_spatial",
    "zonal_boxes",
    "zonal_merge",
    "ecdf_masspoints",
    "row_ids",
    "heap_jump",
    "iv_donut_grid",
    "ols_two_regressors",
    "welch_means",
    "side_lines",
    "treatment_by_bin",
    "rd_local_linear",
    "rd_bandwidth",
    "rd_covariates_grid",
    "rd_balance_grid",
    "rd_size_grid",
    "rd_spec_curve",
    "side_smooth",
    "density_test",
    "density_curve",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from umbral.plans.catalogue import QUERIES

    QUERIES["value_counts"](spark, folder).collect()  # start-up cost is not part of the figures
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
