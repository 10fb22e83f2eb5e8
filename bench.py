"""Headline queries, timed one after the other; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "a07_region_export",
    "b14_padded_other_jets",
    "c09_rescaled_pair_mass",
    "c10_two_higgs_mass",
    "c17_thrust",
    "d05_all_histograms",
    "d09_mass_plane",
    "e02_round_robin_blocks",
    "e04_nearest_neighbours",
    "f03_block_pair_moments",
    "h11_monotone_coupling",
    "h05_thrust_aligned_minimum",
    "i01_benchmark_model",
    "i02_classifier_model",
    "i03_transport_knn_10",
    "i04_transport_classifier",
    "i05_single_coupling_model",
    "i14_benchmark_against_truth",
    "j02_auc_negative_weights",
    "j04_bamber_interval",
    "j07_overtraining",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    shared = tempfile.TemporaryDirectory(prefix="tagshift-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tagshift-bench")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", shared.name).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from tagshift.catalog import QUERIES

    QUERIES["a09_weight_vector"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    spark.stop()
    shared.cleanup()


if __name__ == "__main__":
    main()
