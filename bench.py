"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line. Each query is executed in full into Spark's no-op
sink (every row computed, nothing collected)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from segscope.plans.registry import all_queries  # noqa: E402
from segscope.session import build_session  # noqa: E402

HEADLINE = [
    "indicators_line", "kpis_line", "kpis_order", "pareto", "key_items", "pareto_summary", "gini",
    "outlier_summary", "cluster_stability", "improvement_potential", "compare_clusters", "recommendations",
    "profile_columns", "impute_median", "label_encode", "cluster_stats", "box_stats",
    "tfidf_long", "cluster_keywords", "one_hot_long", "pareto_sums", "box_outliers", "extract_set", "consolidate",
    "assign_nearest", "silhouette", "davies_bouldin", "compare_sets",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    qs = all_queries()
    times = {}
    qs["indicators_line"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up: JVM and first scan
    for name in names:
        fn = qs[name][0]
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "spark": spark.version}))


if __name__ == "__main__":
    main()
