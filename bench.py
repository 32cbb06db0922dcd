"""Headline queries on one folder of tables; prints one JSON line.

Each query is built and run into the no-op sink: one warm-up, then the best of ``BENCH_RUNS`` runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threatspark.plans import load_all  # noqa: E402
from threatspark.session import build_session  # noqa: E402

HEADLINE = {
    # query: table whose rows it processes
    "threats_by_class_and_severity": "events",
    "flow_features": "events",
    "flows_with_running_cardinalities": "events",
    "flow_decisions": "events",
    "detection_alerts": "events",
    "volume_drift": "events",
    "dns_query_verdicts": "events",
    "dns_calibration": "events",
    "tls_session_verdicts": "lineitem",
    "tls_handshake_verdicts": "lineitem",
    "fusion_outcome": "events",
    "repeated_alerts": "events",
    "alert_stats": "events",
    "clean_rows": "lineitem",
    "cleaning_account": "lineitem",
    "column_statistics": "lineitem",
    "correlations": "lineitem",
    "exact_split": "orders",
    "threshold_scan": "lineitem",
    "isolation_scores": "embeddings",
    "forest_predictions": "embeddings",
    "batch_inference": "embeddings",
}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = sys.argv[1:] or list(HEADLINE)
    spark = build_session(cores)
    queries = load_all().QUERIES
    seconds, rate = {}, {}
    for name in chosen:
        best = None
        for attempt in range(runs + 1):
            started = time.perf_counter()
            run(queries[name](spark, path))
            took = time.perf_counter() - started
            if attempt:
                best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        table = HEADLINE.get(name, "events")
        rows = spark.read.parquet(f"{path}/{table}.parquet").count()
        rate[name] = round(rows / best, 1)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rate,
                "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
