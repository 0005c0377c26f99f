"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]. Every query is run
once to warm up and then timed once; results are written to the no-op sink, so that all
rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import time

from riskweave.plans.queries import registry
from riskweave.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "overview",
    "fraud_by_merchant_cat",
    "daily_velocity",
    "rolling_velocity_1h",
    "bin_attack",
    "impossible_travel",
    "ato_risk",
    "ato_geo_risk",
    "ato_travel_linked",
    "weekly_cards",
    "merchant_chargebacks",
    "structuring",
    "hybrid_decisions",
    "hybrid_summary",
    "score_summary",
    "features_v1",
    "features_v2",
    "feature_stats",
    "stratified_split",
    "ranking_metrics",
    "threshold_sweep_score",
    "signal_coverage",
    "engine_comparison",
)


def main() -> None:
    spark = build_session(
        "riskweave-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            started = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
