"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).  Each query is
run in full into Spark's no-op sink; the best of BENCH_RUNS runs (default 2) counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

import check
from rowloom.queries import QUERIES

HEADLINE = [
    "filter_num_range",
    "filter_date_range",
    "filter_text_number",
    "filter_split_counts",
    "switch_route",
    "calc_add",
    "calc_datediff",
    "select_values",
    "select_cast_null",
    "vars_per_date",
    "join_inner",
    "join_left",
    "join_full",
    "join_null_text_keys",
    "union_inputs",
    "compare_all",
    "compare_dups",
    "upsert_keyed",
    "upsert_repeated_target",
    "update_many_rows",
    "delete_keyed",
    "merge_counts",
    "sql_named",
    "sql_each_row",
    "group_sum_count",
    "semi_recent",
    "topk",
    "prev_event_minutes",
    "prev_event_split",
    "event_pivot",
    "overlap_split",
    "row_number_global",
    "work_wait_flow",
    "process_time_flow",
    "routed_flow",
    "log_steps",
    "run_totals",
    "csv_round_trip",
    "workbook_table",
    "stream_routed",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores, runs = int(os.environ.get("BENCH_CPUS", "8")), int(os.environ.get("BENCH_RUNS", "2"))
    spark = check.session(cores)
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1], "cpus": cores}))


if __name__ == "__main__":
    main()
