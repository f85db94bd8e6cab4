"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "corrected_populations", "soft_confusion", "empirical_confusion", "effective_n_by_beta", "threshold_sweep", "weighted_manifest", "lambda_sweep_populations",
    "confidence_tiers", "ari", "nmi_v_measure", "class_moments", "confound_corr", "gmm_fit", "bootstrap_ci", "mc_confusion", "map_localization", "basins_2d",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from simplexa.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = catalog.queries()
    run["hard_populations"](spark, sf_dir).collect()  # starts the executors
    times = {}
    for name in HEADLINE:
        t = time.time()
        run[name](spark, sf_dir).collect()
        times[name] = round(time.time() - t, 3)
        spark.catalog.clearCache()
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
