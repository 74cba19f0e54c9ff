"""Times the headline queries and prints one JSON line.

`BENCH_SF_DIR` names the data, `BENCH_CPUS` the local cores.  Every query runs once to warm up and
is then timed; its result goes to Spark's `noop` sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import time

from leadloom.plans.catalogue import QUERIES
from leadloom.session import local_session

HEADLINE = (
    "clean_contacts", "dedup_first_wins", "ingest_outcome", "geo_profile", "leads_by_country",
    "validation_join", "overview_stats", "industry_cards", "industry_detail", "facet_options",
    "lead_search_page", "export_leads", "header_mapping", "page_title_meta", "page_links",
    "page_text_parser", "robots_filter", "page_join", "search_plan", "prompt_column",
    "coerce_extraction", "enrichment_run", "run_stage_rollup", "redact_log", "hits_in_window",
    "throttle_events", "throttle_hot_keys", "ingest_files", "stream_ingest",
)


def seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": cpus})
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get(
        "BENCH_QUERIES"
    ) else HEADLINE
    times = {}
    for name in names:
        seconds(spark, name, sf_dir)
        times[name] = round(seconds(spark, name, sf_dir), 3)
    print(json.dumps({
        "metric": "headline queries, total time after one warm-up run",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
