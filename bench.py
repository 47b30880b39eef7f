"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print
one JSON line.  Each query starts cold (no shared experiment, no cached table) and is timed from the builder call (its eager fit /
threshold jobs included) to the end of a full ``noop`` write of the result."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "split_train_test",
    "inject_mixed_chain",
    "scenario_parts",
    "impute_median_mode",
    "metrics_median_mode",
    "metrics_lineitem_mar",
    "metric_store_rmse_by_imputer",
    "imputation_disparity",
    "knn_impute",
    "cluster_impute",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from lacuna.session import local_session
    from lacuna.plans import catalog

    spark = local_session(cpus, app="lacuna-bench")
    qs = catalog.queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    # warm-up: JVM, parquet footers, python workers
    qs["split_train_test"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        catalog.reset()
        spark.catalog.clearCache()
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
