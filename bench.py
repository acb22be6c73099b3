"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm the JVM up and once for the clock; rows go to the no-op
sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tardygrade import catalog  # noqa: E402
from tardygrade.session import local_session  # noqa: E402

HEADLINE = [
    "silver",
    "carrier_stats",
    "duplicate_groups",
    "summary_ops",
    "hist_route",
    "ctx7_origin_hour",
    "ctx7_carrier_hour",
    "event_history",
    "features_v1",
    "features_v2",
    "freq_encode",
    "median_impute",
    "threshold_sweep",
    "roc_auc",
    "airline_risk",
    "model_kpis",
    "rf_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "8g"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry = catalog.queries()

    seconds = {}
    for name in chosen:
        for _ in range(2):
            start = time.perf_counter()
            registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
