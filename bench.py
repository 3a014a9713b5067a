"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tallystone.plans.catalog import QUERIES
from tallystone.session import local_session

HEADLINE = (
    "fifo_position", "fifo_realized", "fifo_open_lots", "fifo_matches", "last_price", "cash_totals", "valuation_latest", "snapshot_daily",
    "trade_merge", "cashflow_merge", "fx_merge", "instrument_merge", "raw_dedupe_counts", "artifact_dedupe", "map_trades",
    "xml_rows", "parse_dates", "parse_timestamps", "eod_mark", "fx_fallback", "pnl_by_label",
    "provenance", "recon_diff", "drilldown", "dq_rules", "run_state", "slo_success_rate", "slo_p95",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["fifo_position"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not measured
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
