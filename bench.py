"""Wall-clock of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from framefusion.plans import load  # noqa: E402
from framefusion.session import build_session  # noqa: E402

HEADLINE = (
    "flagship_vote", "detection_features", "rule_score", "candidate_features", "value_groups", "value_group_gate",
    "evaluate_by", "folder_summary", "refine_numeric", "slot_metrics", "track_regions", "find_field", "sequence_consensus",
    "sweep_thresholds", "match_boxes", "temporal_composite_median",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_wall_clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
