"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion into Spark's ``noop`` sink (full execution,
nothing collected). The raw-log files and subscription envelopes are written once before timing
(data preparation, not a query). Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meterwise.plans.catalog import REGISTRY  # noqa: E402
from meterwise.sources import raw_records  # noqa: E402
from meterwise.session import build_session  # noqa: E402

HEADLINE = (
    "user_month_spend", "usage_rollup", "budget_status", "leaderboard", "model_leaderboard",
    "top_users_model_month", "detail_with_user_spend", "kpi_tiles", "top_users_others",
    "user_model_heatmap", "spend_histogram", "metrics_by_model", "metrics_cube", "series_5m_total",
    "spend_alerts", "token_crossings", "enforcement_decisions", "enforcement_throttle",
    "decode_records", "decode_subscription", "object_rollup", "usage_counters", "stream_rollup",
    "scheduled_rollup",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in REGISTRY]
    spark = build_session(f"local[{cpus}]", app="meterwise-bench", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    raw_records.write_log_fixture(spark, sf_dir)
    raw_records.write_envelope_fixture(spark, sf_dir)
    REGISTRY["user_month_spend"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        REGISTRY[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    total = round(sum(times.values()), 3)
    out = {"metric": "headline_queries_total_seconds", "value": total, "unit": "sec", "queries": times,
           "sf": os.path.basename(sf_dir).replace("sf", ""), "cpus": int(cpus),
           "rollup_rows_per_sec": round(events / times["usage_rollup"], 1) if times.get("usage_rollup") else None}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
