"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from courtloom.plans import catalog
from courtloom.session import build_session

HEADLINE = (
    "prj04_homography", "agg01_best_detection", "jn03_ball_box_join", "jn05_nearest_detection", "jn06_nearest_event", "jn14_greedy_match",
    "win01_rle_segments", "win02_hysteresis_holder", "win08_track_gap_fill", "win13_rim_arrivals", "agg10_ball_candidate_fusion", "agg16_identity_health",
    "agg28_average_precision", "trk02_ball_trajectory", "trk03_ball_tracker", "trk04_cross_camera_fusion", "trk08_iou_tracker", "trk09_identity_claims",
    "trk10_identity_chaining", "trk11_two_way_identities", "trk14_joint_assignment", "trk15_cross_camera_correction", "trk20_fusion_grid_search",
    "evt00_ball_story_segments", "evt05_shot_detection", "evt07_shooter_attribution", "evt16_turnovers_steals", "etl08_capped_identity_sample",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("courtloom-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = [n for n in (sys.argv[1:] or HEADLINE)]
    queries["agg01_best_detection"](spark, sf).write.format("noop").mode("overwrite").save()      # JVM warm-up
    times = {}
    for name in names:
        begin = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
