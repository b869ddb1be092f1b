"""Time the headline queries after a warm-up, median of three runs; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from medgrain.queries import REGISTRY
from medgrain.session import build_session

HEADLINE = (
    "flt_active_event_by_kind", "flt_paged_listing", "join_encounter_index", "join_best_match", "join_asof",
    "agg_lab_family", "agg_state_status", "agg_ordinal_agreement", "agg_tag_frequency", "fn_rule_score",
    "fn_normalize_name", "win_representative", "win_latest_version", "srt_topk_frequency", "set_union_sources",
    "dq_expectations", "job_cohort", "job_state",
)
#: Longer jobs, timed once after the others; they are not part of the total, which stays comparable.
HEAVY = ("job_events", "job_scores", "job_temporal", "job_dataset", "win_review_queue")
RUNS = 3


def seconds_of(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    cold = {name: round(seconds_of(spark, name, sf_dir), 3) for name in HEADLINE}
    seconds = {name: round(median(seconds_of(spark, name, sf_dir) for _ in range(RUNS)), 3) for name in HEADLINE}
    heavy = {name: round(seconds_of(spark, name, sf_dir), 3) for name in HEAVY}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cold_seconds": cold,
        "cold_value": round(sum(cold.values()), 3), "heavy_seconds": heavy,
    }))


if __name__ == "__main__":
    main()
