"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "an1_classify_reason_counts", "wn4_wn6_growth_targets", "wn7_wn8_momentum", "jn9_days_since_previous", "wn12_month_index", "ag18_area_history",
    "ag8_weighted_median", "an4_out_of_fold_priors", "ag20_error_metrics", "an11_monthly_mad_screen", "jn10_an30_nearest_vectors", "jn11_shared_key_pairs",
    "an19_jn6_pair_features", "an24_connected_components", "an31_so4_full_text_top", "an32_rank_fusion", "an36_ranking_metrics", "an40_psi_numeric", "an42_ks_distance", "an44_event_log_statistics",
]


def main() -> None:
    from terrane.plans import QUERIES
    from terrane.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["prj15_drop_counts"](spark, sf_dir).collect()  # start-up is not timed
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
