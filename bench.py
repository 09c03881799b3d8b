"""Times the registered queries; prints one JSON line.

BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline queries)
BENCH_REPEATS  timed runs per query, the median counts (default 1)

Every query runs in full: the result goes to the no-op sink, so nothing is
pruned away and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from feedloom.plans import catalog
from feedloom.session import build_session

HEADLINE = [
    "stg_reviews", "load_audit", "daily_app_metrics", "version_adoption", "daily_topic_metrics", "review_samples",
    "top_weekly_risers", "length_percentiles", "first_topic_cohort", "topic_cooccurrence", "marker_share",
    "alert_detectors", "alert_episodes", "incident_match", "did_effects", "release_impact", "topic_shift",
    "rollout_overlap", "mention_candidates", "relations", "switching_matrix", "flow_reasons", "rating_penalties",
    "issue_cost", "rice_stability", "stratified_sample", "keyword_sample", "label_agreement", "topic_scores", "text_topic_scores",
    "alert_operating_curve", "dq_report", "published_tables", "kpi_30d"]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    catalog.BUILDERS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = list(catalog.BUILDERS) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = build_session("feedloom-bench", f"local[{cpus}]", int(cpus), **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    run(spark, "daily_app_metrics", sf_dir)   # JVM and Python warm-up, not timed
    times = {}
    for name in names:
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(repeats)), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
