"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.queries import QUERIES  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = (
    "f4_equity_boost",
    "k2_budget_queue",
    "e2_cell_rate",
    "e3_nearest_hydrant",
    "e5_knn_rate",
    "g1_dedup_first",
    "g6_as_of_history",
    "h1_global_sort_positions",
    "i1_random_split",
    "i9_average_precision",
    "i14_metrics_long_form",
    "f7_quantile_at_level",
    "j2_label_features",
    "j12_conformal_threshold",
    "j14_group_thresholds",
    "k0_clean_job",
    "k5_fairness_audit",
    "j7_boosted_calibrated",
    "l3_live_area_shares",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    # start the JVM's code paths once, so that the first query is not charged for them
    QUERIES["f4_equity_boost"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
