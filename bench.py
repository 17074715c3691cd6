"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores. Every
query is built and run in full; its result goes to a sink that takes and drops rows.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tagloom.catalog import QUERIES  # noqa: E402
from tagloom.session import local_session  # noqa: E402

HEADLINE = [
    "search_and_tags", "search_terms", "latest_222", "rows_around_each", "update_stats", "top_tags",
    "duplicate_report", "ema_duration", "max_duration", "clean_title", "url_domain", "extract_links",
    "diff_tags", "upsert_tags", "occ_classify", "sync_reconcile", "merge3_text", "rec_merge",
    "sync_round", "cosine_pairs", "similarity_graph", "segment_documents", "rebuild_documents",
    "outline_records", "write_snapshot", "cdc_apply", "debounce_events",
]


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    run(spark, folder, "max_tid")  # start-up is not part of any query
    times = {name: round(run(spark, folder, name), 3) for name in HEADLINE}
    found = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else None}))


if __name__ == "__main__":
    main()
