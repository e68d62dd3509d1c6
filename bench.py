"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from hirelake.plans import registry
from hirelake.session import local_session

HEADLINE = [
    "board_match_top25", "facets", "f_search", "search_rank", "count_new", "ingest_batch", "reconcile", "collapse_duplicates",
    "repoint_interactions", "overview", "activity", "location_suggestions", "crawl_worklist", "board_fingerprint",
    "resume_titles", "sent_snapshot", "backfill_events",
]
# Minutes each at sf0.1; run with BENCH_LONG=1.
LONG = ["score_text", "resolve_near_duplicates", "merge_companies", "dedupe_listing", "extract_profiles", "digest"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=2 * cpus, app="bench", memory=os.environ.get("BENCH_MEMORY", "16g"))
    run = registry.queries()
    # The first query would otherwise pay for starting the executor threads and reading footers.
    run["count_by_status"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE + (LONG if os.environ.get("BENCH_LONG") else []):
        start = time.perf_counter()
        run[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
