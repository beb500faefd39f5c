"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder of the driver's tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names to run instead of the headline set
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "gold_port_product",
    "silver_trades",
    "silver_delta",
    "channel_summary",
    "gold_reconcile",
    "landing_profile",
    "normalize_aliases",
    "normalize_decimals",
    "normalize_timestamps",
    "normalize_errors",
    "event_identity",
    "dq_failures",
    "classify_outcomes",
    "outcome_counts",
    "batch_summary",
    "dedupe_against_history",
    "dedupe_reserve_release",
    "dead_letters",
    "publish_envelope",
    "bus_decode",
    "stream_decode",
    "src_batch_records",
    "ingest_all_channels",
    "append_if_absent",
    "land_trade_rows",
    "landed_by_date",
    "events_filtered",
    "events_page",
    "events_page_after",
    "compact_partition",
    "gold_refresh",
    "silver_upsert",
    "bus_landing",
    "stream_dedupe_window",
    "stream_ingest",
    "stream_all_channels",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    chosen = tuple(names.split(",")) if names else HEADLINE

    from quayside.session import build_session
    from workload import inputs
    from workload.queries import event_store, registered

    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__driver__memory="16g",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()

    started = time.perf_counter()
    inputs.lines(spark, sf_dir)
    seconds = {"derive_trades": round(time.perf_counter() - started, 3)}
    if any(name.startswith(("events_", "landed_")) for name in chosen):
        started = time.perf_counter()
        event_store(spark, sf_dir)
        seconds["write_event_store"] = round(time.perf_counter() - started, 3)
    for name in chosen:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)

    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1],
        "rows_per_second": {
            name: round(lines / seconds[name]) for name in ("classify_outcomes", "stream_ingest") if name in seconds
        },
    }
    spark.stop()
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
