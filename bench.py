"""Time every query over the event tables and print one JSON line.

BENCH_SF_DIR names the table directory, BENCH_CPUS the number of local cores.
Queries write to the ``noop`` sink, so that every row is computed and none is
sent to the driver.
"""

import json
import os
import time

from habitloom.plans.queries import QUERIES
from habitloom.session import build_session

# Timed warm, after a first run; all others are timed at their first run.
HEADLINE = (
    "sequences_from_events", "transition_graph", "precedence_matrix", "event_tensor_count", "event_tensor_decay",
    "top_successors", "quality_summary", "tv_penalty", "overuse_guard_suppress", "fuse_multiplicative",
    "causal_consistency", "causal_tof_scores", "causal_tof_rank", "weighted_resample", "train_validation_split",
    "markov_loss_action", "iqr_outliers", "utility_readmission", "anomaly_eval", "validate_sequences",
    "ablation_pivot", "result_integrity", "stage_lineage",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", cpus, "bench", {
        "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in QUERIES:
        for _ in range(2 if name in HEADLINE else 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
