"""Time the headline queries and print one JSON line.

Each query is run in full (every column of every row is worked out) and its rows are dropped.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
# Python workers started by Spark must find the package as well.
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from hirespan.plans import catalog  # noqa: E402
from hirespan.session import build_session  # noqa: E402

HEADLINE = [
    "arrival_percentile_w4_w7",
    "snapshot_percentile_w5",
    "leaderboard_w8",
    "feed_page_o1_o2",
    "feed_summary_a3_a4",
    "application_list_j1",
    "accept_applications_j8_f14_f18",
    "match_scores_j5_p3_p7",
    "application_funnel_a8",
    "ghost_score_a7_p10",
    "best_analysis_w2_j10",
    "skill_extraction_p1",
    "skill_sets_p1_a11_u2",
    "pair_match_j7_p2",
    "skill_tree_a10_p27",
    "strip_tags_p15",
    "clean_cells_p16",
    "html_listing_s2_w3_p16",
    "board_postings_s4_p15",
    "analysis_records_p19",
    "job_upsert_u5_w6",
    "latest_status_u11",
    "attempts_over_limit_st5",
]


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(catalog.QUERIES)
    spark = build_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, driver_memory="16g")
    run(spark, "latest_status_u11", sf_dir)  # start the executor threads and read footers once
    seconds = {}
    for name in names:
        seconds[name] = round(run(spark, name, sf_dir), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
