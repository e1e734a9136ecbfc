"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the input, BENCH_CPUS (default 8) the local cores.
Every query is run to completion; its rows go to a no-op sink, so that nothing is cut short. The
better of two runs counts, which leaves class loading and code generation out.
"""

from __future__ import annotations

import json
import os
import sys
import time

from auditframe.session import build_session
from auditframe.workload import QUERIES

HEADLINE = (
    "flagship_target_variance", "target_facts_with_contributor", "group_metrics_all",
    "overall_metrics", "distribution", "correlation", "filter_ranges", "derive_divide_ratio_percentage", "dedupe_keep_first",
    "join_diagnostics_one_to_many", "join_chain_by_role", "join_outer", "rank_dense", "rank_dense_ascending_by_range",
    "rolling_mean_per_user", "percent_change_monthly", "profile_numeric_lineitem",
    "profile_categorical_orders", "category_snapshot_documents", "recurring_metrics_by_period", "compare_metric_changes",
    "sales_regional_performance", "source_to_target_table", "mapping_candidates", "claims_verified", "call_usage_by_type",
    "chunk_documents", "token_vectors_documents", "cosine_topk_sparse", "cosine_topk_every_document", "cosine_topk_dense", "csv_export_and_scan",
    "csv_one_file_in_ranges", "json_one_array_in_ranges",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executor threads
    seconds = {}
    for name in names:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(min(runs), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
