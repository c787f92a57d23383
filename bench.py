"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ONLY (comma-separated names) to run some of them.
"""

from __future__ import annotations

import json
import os
import time

from flareframe import get_session
from flareframe.queries import all_queries

HEADLINE = ["a01_resample_mean", "a13_fit_robust", "a17_sample_weights", "a19_confusion", "d05_sample_per_group",
            "d08_keep_flag", "d10_stratified_split", "d14_group_split_cumulative", "d18_weighted_bootstrap",
            "e1_flux_windows", "e2_augmented_clips", "j02_label_ahead", "j04_history_ordinal",
            "j06_label_at_offset", "m15_threshold_curves", "m21_expected_scores_uniform", "m26_roc_auc_ties",
            "m30_consensus_threshold", "m34_flat_report", "q01_composition", "t12_tokens_by_variate",
            "w04_fixed_series", "w05_clips", "w09_fill_linear", "x02_binary_logit"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = get_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()       # start the engine before the clock
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
