"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "evidence_triage", "dedup_first_wins", "rank_total_order", "placement_running_cap", "exclusion_audit", "composite_key_join", "full_outer_membership", "field_change_records", "confusion_matrix",
    "ndcg_at_10", "pairwise_order_accuracy", "set_match_micro", "term_score_accept", "integrity_rollup", "text_normalize", "pii_scope_screen", "json_field_state", "slice_caps",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from sievelake.plans.registry import queries

    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, took = queries(), {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles code
            start = time.perf_counter()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - start)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, better of two runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
