"""Time the headline queries: one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from ringsift.queries import QUERIES
from ringsift.session import local_session

HEADLINE = [
    "ag02_prefix_risk", "ag01_reputation", "ag03_prefix_histogram", "ag06_operator_code_risk", "ag35_ngram_counts", "jn01_numbering_lookup",
    "jn03_full_outer", "jn06_prefix_backoff", "jn13_blocked_numbers", "jn17_callbacks", "jn22_recent_apps", "jn23_recent_notifications",
    "wn01_source_priority", "wn06_stratified_split", "wn16_call_frequency", "wn17_prefix_calls", "wn19_missed_no_callback", "ag10_per_class_metrics",
    "ag13_tune_three_class", "ag18_calibration_error", "ag20_auc_one_vs_rest", "ag23_ks_distance", "dec01_weak_labels", "dec07_risk_factors",
    "dec10_implicit_labels", "ft04_entries", "ft02_compact_features", "ft06_device_features", "sc01_normalize", "sc13_operator_bucket", "sc50_page_text",
    "sc55_categories", "pg11_block_sites", "st05_lookback_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # The first job of a session pays for starting the engine, not for a query.
    spark.read.parquet(f"{folder}/region.parquet").count()
    names = sys.argv[1:] or HEADLINE
    took = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
