"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local threads.
Each query runs once to warm up and three times for its median; the result is counted in
full, so every column is computed.  When BENCH_SECONDS (default 1200) have gone by, or the
process is told to end, the line holds the queries timed so far and names the others.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from lineagelake.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "extract_dna_long", "qc_filter_phred33", "extract_both", "umi_counts", "cluster_barcodes", "collapse_barcodes", "reference_exact_list",
    "reference_approx", "adapter_linked", "assign_clones", "qc_metrics_var", "box_stats",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    until = time.time() + float(os.environ.get("BENCH_SECONDS", "1200"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def report() -> None:
        line = {"metric": "total of median query times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        if missing := [q for q in HEADLINE if q not in took]:
            line["not_timed"] = missing
        print(json.dumps(line), flush=True)

    def stop(*_) -> None:
        report()
        os._exit(0)

    signal.signal(signal.SIGTERM, stop)
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
            if time.time() > until:
                break
        took[name] = round(median(runs[1:] or runs), 3)
        print(name, took[name], file=sys.stderr, flush=True)
        if time.time() > until:
            break
    report()
    spark.stop()


if __name__ == "__main__":
    main()
