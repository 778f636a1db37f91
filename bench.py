"""Wall-clock of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (names or prefixes, default the headline list; ``all`` for every one).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "b07_cosine_topk", "b09_query_by_row", "b15_scoped_window_search", "c03_sliding_windows", "c04_window_action_overlap",
    "c09_frame_manifest", "c13_nearest_frame_asof", "c19_decode_refinement", "d01_diversify_by_interval", "d02_merge_events",
    "d06_lexical_search", "d10_guarded_search", "d13_diverse_search", "e03_timeline", "f04_pose_join", "f08_propagate_labels",
    "g01_pose_retrieval_rows", "g09_traversal_rows", "g15_recall_summary", "h04_class_nms", "h13_robust_extent",
    "h19_topk_per_group", "s05_event_time_windows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    from evidex.plans import catalog
    from evidex.session import local_session

    spark = local_session(cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = list(HEADLINE)
    if wanted == "all":
        names = list(queries)
    elif wanted:
        names = [n for n in queries if n.startswith(tuple(wanted.split(",")))]
    # One small run first, so that no query pays for the start of the JVM.
    queries["b09_query_by_row"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
